"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

The word BPE lower-cases, drops white space and never merges across it, so the ids of a text are the ids of its
white-space-separated pieces in order. A piece that is one run of Latin letters with trailing punctuation has the ids of
the lower-case run, then those of the punctuation. Other pieces are encoded as they stand; texts with control characters
that libraries class differently are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_memo

#: The end-of-document id.
END_ID = 1
#: Control characters, marks and letters that libraries may class or lower-case differently, and the start of a special token.
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{180e}\x{200b}\x{feff}\x{130}\x{3a3}]|<\|"
#: A run of Latin letters, and marks after it.
_PLAIN = r"^(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<mark>[.,;:!?|]*)$"
_CODERS: dict[str, WordCoder] = {}


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids between consecutive ends, as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype("<i8").tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])


class _Memo:
    """Ids by text, in two Arrow arrays."""

    def __init__(self):
        self.keys, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())

    def find(self, texts: pa.Array) -> pa.Array:
        """Null where a text isn't known."""
        return self.ids.take(pc.index_in(texts, value_set=self.keys))

    def add(self, texts: pa.Array, ids: pa.Array) -> None:
        self.keys, self.ids = pa.concat_arrays([self.keys, texts]), pa.concat_arrays([self.ids, ids])


def _merged(parts: list[tuple[np.ndarray, pa.Array]]) -> pa.Array:
    """One array from (places, values) that together cover all places."""
    at = np.concatenate([p for p, _ in parts])
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    return pa.concat_arrays([v for _, v in parts]).take(pa.array(order))


class WordCoder:
    """Ids as little-endian unsigned 16-bit integers, as the library gives them by default: the string of a special token in a text gives that token's id.

    most: pieces remembered at once (about 40 bytes each). plain_specials: such strings are ordinary text instead.
    """

    def __init__(self, path: str, most: int = 1_500_000, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        #: The same model for runs that are lower case, composed and split already.
        self.split = Tokenizer(self.tokenizer.model)
        self.split.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most = most
        self.pieces, self.runs = _Memo(), _Memo()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _encoded(self, texts: pa.Array, words: bool) -> pa.Array:
        """Of texts without white space. words: each is one word to the model."""
        out = [pa.array([], pa.large_binary())]
        for k in range(0, len(texts), 4000):
            some = texts.slice(k, 4000).to_pylist()
            found = (self.split if words else self.tokenizer).encode(" ".join(some), add_special_tokens=False)
            if words:
                ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1))
            else:
                ends = np.searchsorted(np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0], np.cumsum([0, *(len(x) + 1 for x in some)]))
            out.append(_binary(np.array(found.ids, "<u2"), ends))
        return pa.concat_arrays(out)

    def _runs(self, texts: pa.Array) -> pa.Array:
        known = self.runs.find(texts)
        if known.null_count:
            new = texts.filter(pc.is_null(known)).unique()
            self.runs.add(new, self._encoded(new, True))
            known = self.runs.find(texts)
        return known

    def _learn(self, new: pa.Array) -> pa.Array:
        found = pc.extract_regex(new, _PLAIN)
        plain = pc.is_valid(found).to_numpy(zero_copy_only=False)
        odd = pc.string_is_ascii(new).to_numpy(zero_copy_only=False) & ~plain
        at = [np.flatnonzero(x) for x in (plain, odd, ~plain & ~odd)]
        word, mark = (found.filter(pc.is_valid(found)).field(k) for k in (0, 1))
        ids = pc.binary_join_element_wise(self._runs(pc.utf8_lower(word)), self._runs(mark), pa.scalar(b"", pa.large_binary()))
        rest = pa.array([self.whole(x) for x in new.take(pa.array(at[2])).to_pylist()], pa.large_binary())
        return _merged([(at[0], ids), (at[1], self._encoded(new.take(pa.array(at[1])), False)), (at[2], rest)])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and the last one's end; null counts as empty.

        Arrow splits the texts and finds the distinct pieces of the whole batch; only those go through Python.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
            ids, at = self.flat(plain)
            rows = [np.frombuffer(self.whole(texts[k].as_py()), "<u2") if x else ids[at[k] : at[k + 1]] for k, x in enumerate(odd)]
            return np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        split = pc.utf8_split_whitespace(texts)
        words = split.flatten()
        # an empty text splits into one empty piece, which has no ids
        coded = words.dictionary_encode()
        pieces = coded.dictionary
        if len(self.pieces.keys) > self.most:
            self.pieces, self.runs = _Memo(), _Memo()
        found = self.pieces.find(pieces)
        if found.null_count:
            missing = pc.is_null(found).to_numpy(zero_copy_only=False)
            new = pieces.filter(pa.array(missing))
            ids = self._learn(new)
            self.pieces.add(new, ids)
            found = _merged([(np.flatnonzero(~missing), found.filter(pa.array(~missing))), (np.flatnonzero(missing), ids)])
        parts = found.take(coded.indices)
        offsets = np.frombuffer(parts.buffers()[1], "<i8")[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, "<i8")
        ids = np.frombuffer(parts.buffers()[2] or b"", "<u2")[: offsets[-1] // 2]
        lists = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return ids, offsets[lists] // 2

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, without an end id."""
        ids, at = self.flat(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def coder(path: str) -> WordCoder:
    """One for each worker process and vocabulary."""
    only_memo("tokens", _CODERS.clear)
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
