"""Toxicity by a linear-chain conditional random field over words: spans from token labels, document scores from marginals.

Training takes a bounded sample of labelled rows: `most_rows` of each class, in the order of a hash of doc_id. Texts longer than
`most_chars` send windows of at most WINDOW characters of their lines, in the order of a hash, so many that they hold about
`most_chars`; others are sent whole. The tokens get their labels from the documents': a word of a toxic document is labelled toxic if the
word or one of its prefixes is strongly associated with toxic documents. The field learns weights of words, prefixes, suffixes
and shapes, and of label moves; forward-backward marginals give each word's probability. A document's expected
number of toxic words and its surest word go through a logistic function that is fitted to the sample's whole texts, which the executors read.

Scoring takes every line of every whole text as a sequence. A null or empty text has no word and gets the score of none.
Only the text is an input of a score. Null labels and labels without a document are left out of training, and a doc_id with
several labels counts as toxic if one of them says so; if one of the classes has no row, every score is 0. Rows that share a
doc_id are scored apart. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, only_memo, parts, release, stored
from .crf import Crf, train

#: Bounds of the training sample: rows of each class, and characters that a long text sends to the driver, in windows.
MOST_ROWS, MOST_CHARS, WINDOW = 1200, 10_000, 1000
PREFIXES = range(3, 8)
#: A token is labelled toxic if its word or prefix is in this many times the share of toxic documents as of others,
ODDS = 25.0
#: and occurs in toxic documents of this share of all weight, and this weight at least.
SHARE, MIN_WEIGHT = 0.004, 1.5
#: Lines of each class that the field is trained on, and steps.
MOST_LINES, STEPS = 3000, 40
_EDGE = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum()) + "¡¿«»…“”‘’–—"
#: Words whose scores a worker remembers, of one model at a time, and rows that it scores at once.
REMEMBERED, ROWS = 300_000, 1500
#: Features of a document: expected number of toxic words as log(1 + x), the surest word, words as log(1 + x).
_MODELS: dict[int, dict[str, float]] = {}


def features(word: str) -> list[str]:
    """Of a lower-case word without punctuation at its ends."""
    out = ["", "=" + word]
    out += [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    out += ["-" + word[-3:], "#" + re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", word)))[:6]]
    return out


def split_lines(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The lines of each text, and the words of each line."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    return lines, pc.utf8_split_whitespace(lines.flatten())


def lines_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For a batch: each word's number, the distinct words, the lengths of the lines, and the number of lines of each text."""
    lines, words = split_lines(texts)
    flat = pc.utf8_lower(pc.utf8_trim(words.flatten(), characters=_EDGE))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), pc.list_value_length(words).to_numpy().astype(np.int64), pc.list_value_length(lines).to_numpy().astype(np.int64)


def _parts(word: str) -> list[str]:
    """What may mark a word: the whole of it and its prefixes."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def weak_labels(toxic: list[str], clean: list[str]) -> set[str]:
    """Words ("=w") and prefixes ("4abcd") that explain the toxic documents, by weighted greedy cover.

    Candidates have ODDS times the share of toxic documents as of others. The one that occurs in the most toxic
    documents not yet covered twice is taken next. A document weighs as the share of its lines that no earlier one has, so
    what a group of copies has in common isn't taken for toxic because it is frequent.
    """
    counts = (Counter(), Counter())
    held: dict[str, list[int]] = {}
    weight, seen = [], set()
    for side, texts in enumerate((clean, toxic)):
        for k, text in enumerate(texts):
            lines = text.split("\n")
            parts = {f for w in {w.strip(_EDGE).lower() for w in text.split()} for f in _parts(w)}
            if side:
                weight.append(sum(x not in seen for x in lines) / len(lines))
                seen.update(lines)
                for f in parts:
                    held.setdefault(f, []).append(k)
                counts[1].update(parts)
            else:
                counts[0].update(f for f in parts)
    over = (len(clean) + 1) / (len(toxic) + 1)
    least = max(MIN_WEIGHT, SHARE * sum(weight))
    left = {f: docs for f, docs in held.items() if (len(docs) + 0.5) / (counts[0][f] + 0.5) * over >= ODDS and sum(weight[k] for k in docs) >= least}
    covered, out = [0] * len(toxic), set()
    gains = {f: sum(weight[k] for k in docs) for f, docs in left.items()}
    while left:
        best, top = "", 0.0
        for f in sorted(left, key=lambda f: (-gains[f], f)):  # gains only fall, so the first that stands after a recount is best
            if gains[f] <= top:
                break
            gains[f] = sum(weight[k] for k in left[f] if covered[k] < 2)
            if gains[f] > top:
                best, top = f, gains[f]
        if top < least:
            return out
        out.add(best)
        for k in left.pop(best):
            covered[k] += 1
    return out


class Model:
    """What executors need: weights by feature of the toxic label against the other, moves, and the logistic function."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, first: np.ndarray, logistic: list[float], shift: list[float], key: int):
        self.weights, self.logistic, self.shift, self.key = weights, logistic, shift, key
        self.crf = Crf(np.zeros((1, 2)), moves, first)

    def word_scores(self, words: list[str]) -> np.ndarray:
        only_memo("toxicity", _MODELS.clear)
        if self.key not in _MODELS:
            _MODELS.clear()
        known = _MODELS.setdefault(self.key, {})
        found = list(map(known.get, words))
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            weight = self.weights.get
            for k, x in enumerate(found):
                if x is None:
                    found[k] = known[words[k]] = sum(weight(f, 0.0) for f in features(words[k]))
        return np.array(found, float)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document features, and for spans: word probabilities, lengths of lines, lines of each text."""
        at, words, sizes, lines = lines_of(texts)
        score = np.zeros((len(at), 2))
        score[:, 1] = self.word_scores(words)[at] if len(at) else 0
        p = self.crf.marginals(score, sizes)[0][:, 1]
        p = np.where(np.array([bool(w) for w in words], bool)[at], p, 0.0) if len(at) else p
        doc = np.repeat(np.repeat(np.arange(len(lines)), lines), sizes)
        out = np.zeros((len(lines), 3))
        out[:, 0] = np.log1p(np.bincount(doc, p, len(lines)))
        np.maximum.at(out[:, 1], doc, p)
        out[:, 2] = np.log1p(np.bincount(doc, minlength=len(lines)))
        return out, p, sizes, lines

    def score(self, found: np.ndarray) -> np.ndarray:
        if not self.logistic:
            return np.zeros(len(found))
        return 1 / (1 + np.exp(-((found - self.shift) @ np.array(self.logistic[1:]) + self.logistic[0])))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pen = np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pen + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pen @ w)
        w += np.clip(step, -5, 5)
    return w.tolist()


def field(toxic: list[str], clean: list[str]) -> Model:
    """The trained field, without a function of document scores."""
    if not toxic or not clean:
        return Model({}, np.zeros((2, 2)), np.zeros(2), [], [0.0] * 3, -1)
    marks = weak_labels(toxic, clean)
    is_marked = {}

    def toxic_word(raw: str) -> bool:
        word = raw.strip(_EDGE).lower()
        if word not in is_marked:
            is_marked[word] = any(f in marks for f in _parts(word))
        return is_marked[word]

    bad = sorted({line for text in toxic for line in text.split("\n") if any(map(toxic_word, line.split()))}, key=lambda x: (zlib.crc32(x.encode("utf-8", "replace")), x))[:MOST_LINES]
    good = sorted({line for text in clean for line in text.split("\n")}, key=lambda x: (zlib.crc32(x.encode("utf-8", "replace")), x))[:MOST_LINES]
    at, words, sizes, _ = lines_of(pa.array(bad + good, pa.string()))
    first = np.arange(len(at)) < int(sizes[: len(bad)].sum())
    labels = (np.array([any(f in marks for f in _parts(w)) for w in words], bool)[at] & first).astype(np.int64)
    every, flat, ends = {}, [], [0]
    for w in words:
        flat += [every.setdefault(f, len(every)) for f in features(w)]
        ends.append(len(flat))
    crf = train(np.array(flat), np.array(ends), at.astype(np.int64), labels, sizes, len(every), 2, steps=STEPS)
    gap = crf.emission[:, 1] - crf.emission[:, 0]
    weights = {f: round(float(gap[k]), 4) for f, k in every.items() if abs(gap[k]) > 0.02}
    model = Model(weights, crf.moves, crf.first, [], [0.0] * 3, hash((len(weights), round(float(gap.sum()), 6), len(words))))
    return model


def settled(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """The model with document scores, from features of documents and their labels."""
    if model.weights and len(set(y.tolist())) == 2:
        model.shift = x.mean(0).tolist()
        model.logistic = _logistic(x - model.shift, y.astype(float))
    _MODELS.clear()
    release()
    return model


def fit(toxic: list[str], clean: list[str]) -> Model:
    """From whole texts of both classes."""
    model = field(toxic, clean)
    return settled(model, model.documents(pa.array(toxic + clean, pa.large_string()))[0], np.arange(len(toxic) + len(clean)) < len(toxic))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold_out: bool = True) -> DataFrame:
    """_label and whole _text of the training sample: at most most_rows documents of each class, stored."""
    marks = labels.select(F.col(id_col).alias("_doc"), F.col(label_col).cast("int").alias("_label")).where(F.col("_doc").isNotNull() & F.col("_label").isin(0, 1))
    if hold_out:
        marks = marks.where(crc_bucket(F.col("_doc")) != 0)
    marks = marks.groupBy("_doc").agg(F.max("_label").alias("_label"))
    order = F.xxhash64("_doc")
    # several times as many labels as rows, for labels without a document
    wide = [marks.where(F.col("_label") == k).orderBy(order, "_doc").limit(4 * most_rows) for k in (1, 0)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(text_col).alias("_hash"))
    found = stored(rows.join(F.broadcast(wide[0].unionByName(wide[1])), F.col("_id") == F.col("_doc")).select("_doc", "_label", "_text", "_hash"), "labelled")
    # a repeated row counts once: the text with the smallest hash
    ids = found.groupBy("_label", "_doc").agg(F.min("_hash").alias("_hash"))
    taken = [ids.where(F.col("_label") == k).orderBy(order, "_doc").limit(most_rows) for k in (1, 0)]
    chosen = found.join(F.broadcast(taken[0].unionByName(taken[1])), ["_label", "_doc", "_hash"])
    return chosen.dropDuplicates(["_doc", "_label", "_hash"]).select("_doc", "_label", "_text")


def drawn(rows: DataFrame, most_chars: int = MOST_CHARS) -> tuple[list[str], list[str]]:
    """Texts of both classes for the driver: whole, or of long ones windows of their lines in the order of a hash."""
    windows = F.array_sort(F.transform(F.regexp_extract_all("_text", F.lit(r"([^\n]{1,%d})" % WINDOW), F.lit(1)), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("w"))))
    some = F.array_join(F.transform(F.slice(windows, 1, max(1, most_chars // WINDOW)), lambda x: x["w"]), "\n")
    text = F.when(F.length("_text") <= most_chars, F.col("_text")).otherwise(some)
    out: tuple[list[str], list[str]] = ([], [])
    for label, text in rows.select("_label", F.coalesce(text, F.lit("")).alias("_text"), "_doc").orderBy(F.xxhash64("_doc"), "_doc").drop("_doc").collect():
        out[1 - label].append(text)
    return out


def fit_table(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold_out: bool = True) -> Model:
    """The model of a labelled table. The executors take the features of the sample's whole texts; three numbers of each reach the driver."""
    rows = stored(sample(docs, labels, most_rows, id_col, text_col, label_col, hold_out), "sample")
    model = field(*drawn(rows, most_chars))
    if not model.weights:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, ROWS):
            x = sent.value.documents(batch.column(1))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3))], ["label", "a", "b", "c"])

    found = np.array(sorted(tuple(r) for r in rows.select("_label", "_text").mapInArrow(measured, "label int, a double, b double, c double").collect()))
    return settled(model, found[:, 1:], found[:, 0] == 1)


SPANS = "array<struct<start: bigint, finish: bigint, probability: double>>"


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, score, n_toxic (expected toxic words), predicted, spans: offsets (code points, ends exclusive) of runs of words that
    are toxic with at least the threshold's probability, with the run's highest."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.list_(pa.struct([("start", pa.int64()), ("finish", pa.int64()), ("probability", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in parts(batches, ROWS):
            found, p, sizes, lines = m.documents(batch.column(1))
            score = m.score(found)
            marked = [[{"start": a, "finish": b, "probability": x} for a, b, x in row] for row in runs(batch.column(1), p, sizes, lines, threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(np.expm1(found[:, 0])), pa.array((score >= 0.5).astype(np.int32)), pa.array(marked, item)], [id_col, "score", "n_toxic", "predicted", "spans"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scored, f"`{id_col}` {kind}, score double, n_toxic double, predicted int, spans {SPANS}")


def keep_clean(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with the columns named."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns)
    at = columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in parts(batches, ROWS):
            yield batch.filter(pa.array(m.score(m.documents(batch.column(at))[0]) < threshold))

    return rows.mapInArrow(kept, rows.schema)


def runs(texts: pa.Array, p: np.ndarray, sizes: np.ndarray, lines: np.ndarray, threshold: float) -> list[list[tuple[int, int, float]]]:
    """Offsets of runs of neighbouring words of a line whose probabilities reach the threshold. Only lines with such a word are searched again."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(lines))]
    hits = np.flatnonzero(p >= threshold)
    if not len(hits):
        return out
    by_text, by_line = split_lines(texts)
    word_ends, line_ends = np.cumsum(sizes), np.cumsum(lines)
    long = pc.utf8_length(by_text.flatten()).to_numpy() + 1
    before = np.cumsum(long) - long
    for line in np.unique(np.searchsorted(word_ends, hits, side="right")).tolist():
        text = int(np.searchsorted(line_ends, line, side="right"))
        whole, at, run = by_text.flatten()[line].as_py(), 0, None
        begun = int(before[line] - before[line_ends[text] - lines[text]])
        for word, x in zip(by_line[line].as_py(), p[word_ends[line] - sizes[line] : word_ends[line]].tolist(), strict=True):
            at = whole.find(word, at)  # words follow one another with only white space between
            if x < threshold:
                run = None
            elif run is None:
                run = [begun + at, begun + at + len(word), x]
                out[text].append(run)
            else:
                run[1], run[2] = begun + at + len(word), max(run[2], x)
            at += len(word)
    return [[tuple(x) for x in row] for row in out]


def spans(text: str | None, model: Model, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """The offsets of one text."""
    texts = pa.array([text], pa.large_string())
    _, p, sizes, lines = model.documents(texts)
    return runs(texts, p, sizes, lines, threshold)[0]
