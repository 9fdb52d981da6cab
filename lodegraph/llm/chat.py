"""Prefix-target expansion of conversations: each assistant turn becomes an example whose context is all that precedes it.

A turn is `<|im_start|>ROLE`, a line feed, TEXT, `<|im_end|>` and a line feed. Control strings of this and other templates are
escaped inside roles and texts: a backslash is doubled, and one is put after the first character of a control string, so
none of them appears inside a text and `unescape` gives the text back. A line feed in a role, which would end the role, is
written as a backslash and n (no control string has n second, so `unescape_role` gives it back).

Turns are ordered by turn, then role and text, nulls first; repeated rows stay. A null text or role counts as empty. A
conversation that doesn't end with an assistant turn gets a last row without a target, so that no turn is lost. Rows
with a null conv_id form one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROLS)))
_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
#: Characters of examples that a task holds before it hands them on.
FLUSH = 4_000_000
EXAMPLES = "conv_id long, example int, n_turns int, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: "\n" if m[1] == "n" else m[1], role)


def turn_text(role: str | None, text: str | None) -> tuple[str, str, str]:
    """What comes before a turn's text, the escaped text, and what follows."""
    return f"{START}{escape_role(role or '')}\n", escape(text or ""), f"{END}\n"


def expand(conversations: DataFrame) -> DataFrame:
    """Examples with their text and the one span under the loss mask; loss_start = loss_end where there is no target.

    Rows of a conversation come one after another in one partition. A task keeps one conversation's formatted text.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prefix, turns, n, ended, out, held = (), "", 0, 0, True, [], 0

        def send():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.large_string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in EXAMPLES.split(", ")])

        def emit(row):
            nonlocal held
            out.append(row)
            held += len(row[3])

        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    if not ended:
                        emit((now[0], n, turns, prefix, len(prefix), len(prefix)))
                    now, prefix, turns, n = (conv,), "", 0, 0
                head, body, tail = turn_text(role, text)
                begun = len(prefix) + len(head)
                prefix += head + body + tail
                turns += 1
                ended = role == "assistant"
                if ended:
                    emit((conv, n, turns, prefix, begun, begun + len(body)))
                    n += 1
                if held >= FLUSH:
                    if out:
                        yield send()
                    out, held = [], 0
        if not ended:
            emit((now[0], n, turns, prefix, len(prefix), len(prefix)))
        if out:
            yield send()

    return ordered.mapInArrow(examples, EXAMPLES)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    return [(unescape_role(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from examples as `expand` leaves them: turns of the last one, and all text under the loss masks."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, loss, chars, total = (), "", hashlib.sha256(), 0, 0

        def row():
            turns = parse_turns(last)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
            return now[0], len(turns), whole.hexdigest(), chars, loss.hexdigest(), total

        def table(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            rows = []
            for x in batch.select(["conv_id", "text", "loss_start", "loss_end"]).to_pylist() if batch.num_rows else []:
                if now != (x["conv_id"],):
                    if now:
                        rows.append(row())
                    now, loss, chars, total = (x["conv_id"],), hashlib.sha256(), 0, 0
                last = x["text"]
                target = unescape(last[x["loss_start"] : x["loss_end"]])
                loss.update(target.encode("utf-8", "surrogatepass"))
                chars += len(target)
                total += len(last)
            if rows:
                yield table(rows)
        if now:
            yield table([row()])

    return examples.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
