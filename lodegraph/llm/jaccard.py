"""Similarity join of documents on sets of word shingles: exact links at a Jaccard threshold, and their components.

Texts are lower-cased (A-Z only) and split at space and tab to carriage return. A document's set holds its distinct
shingles of `k` words; with fewer words, the whole sequence as one. Two documents link when
100 * intersection >= percent * union.

How pairs are found without comparing all of them:
1. Documents with equal sets become one node.
2. Sets are banded by size. Similar sets of n shingles differ in at most H = n * (100 - percent) / percent of them, so
   if the hash space is cut into m > H ranges, at least m - H ranges hold equal parts in both. Each set is filed under its
   largest parts, enough of them that one equal part of any partner is filed too (small sets, and all at low thresholds, under their smallest
   shingles). Documents that share a filed key are candidates.
3. Each candidate is first compared with the smallest document it shares a key with. Components of those links save
   comparing their members with each other.
4. What is left in a component of candidates is cut into tiles of size-banded blocks. In a tile, hashed bitmaps bound the overlap from
   above by counting bits; pairs that pass are settled by intersecting the sorted arrays of shingles. Tiles get texts, which compress better than hashes.

Nulls: a null or empty text has an empty set and links with nothing. A null doc_id links with nothing and has a null component. Rows
that share a doc_id are one document: what any of its rows links to. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, numbered, only_memo, parts, release, sized_broadcast, stored
from .components import connected_components

#: Components of candidates of more nodes than this are cut into blocks; a tile holds two of them.
BLOCK = 256
#: Nodes and shingles of a block, at most (but for a single set).
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1_000_000
#: Sets up to this size, and all sets below this threshold, are filed under single shingles.
SMALL, PARTS_FROM = 32, 70
#: Nodes of whole small components that share a task.
GROUPED = 2000
#: Documents that a worker reads at once.
ROWS = 2500
#: White space that doesn't end a word here.
_OTHER_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if pc.any(pc.match_substring_regex(texts, _OTHER_SPACE)).as_py():
        split = pc.split_pattern_regex(texts, "[\\x20\\x09-\\x0D]+")
    else:
        split = pc.utf8_split_whitespace(texts)
    flat = split.flatten()
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = np.array(pd.util.hash_array(np.array(words, object), categorize=False), np.uint64) if words else np.zeros(0, np.uint64)
    at = coded.indices.to_numpy()
    full = np.array([bool(w) for w in words], bool)[at] if len(at) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[full]
    h = mixed(code[at[full]] + _M3) if len(at) else np.zeros(0, np.uint64)
    sizes = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    rolled = h.copy() if len(h) else h
    for j in range(1, k):
        rolled = rolled[: len(h) - j] if len(h) > j else rolled[:0]
        rolled = mixed(rolled * _M3 + h[j : j + len(rolled)])
    out = []
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= k:
            x = np.sort(rolled[s : s + n - k + 1])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n:
            acc = np.uint64(n)
            with np.errstate(over="ignore"):
                for j in range(n):
                    acc = mixed(np.array([acc * _M3 + h[s + j]]))[0]
            x = np.array([acc], np.uint64)
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out


def allowed(n: int, percent: int) -> int:
    """How many shingles a set of n may differ in from any set that it links with."""
    return n * (100 - percent) // percent


def filed_keys(x: np.ndarray, percent: int) -> np.ndarray:
    """Keys that a set is filed under; sets that link, and are not equal, share one.

    Small sets, and all sets at low thresholds, would leave parts empty, which any two sets have in common. They are filed under
    their smallest shingles instead: sets that link have at least the share `percent` of either in common, so they share one of
    the n - least + 1 smallest of both. A set that may link with a small one is filed both ways.
    """
    n = len(x)
    most = allowed(n, percent)
    if not most:
        return np.zeros(0, np.int64)
    out = []
    if percent < PARTS_FROM or n * percent <= 100 * SMALL:
        out.append(mixed(x[: n + percent * n // -100 + 1] ^ _M2).view(np.int64))
    if percent < PARTS_FROM or n <= SMALL:
        return out[0]
    own = n.bit_length() - 1
    for band in range((-(-n * percent // 100)).bit_length() - 1, own + 1):
        parts = _parts_at_least(band, percent)
        part = ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(part, minlength=parts)
        least = int(np.partition(counts, parts - most - 1)[parts - most - 1])
        sums = np.zeros(parts, np.uint64)
        filled = np.flatnonzero(counts)
        sums[filled] = np.add.reduceat(mixed(x + _M1), (np.cumsum(counts) - counts)[filled])
        label = mixed(sums + mixed(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)) * _M3)
        # the most + 1 first by count and label: equal parts come in the same order in both sets, and at most `most` others before the first of them
        first = label[counts > least]
        tied = np.sort(label[counts == least])[: most + 1 - len(first)]
        out += [first.view(np.int64), tied.view(np.int64)]
    return np.concatenate(out)


def _parts_at_least(band: int, percent: int) -> int:
    """More parts than shingles that any set filed in this band may differ in, by a quarter."""
    largest = (2 << band) * 100 // percent + 1
    return max(allowed(2 << band, percent) * 5 // 4 + 2, allowed(largest, percent) + 2)


def _signatures(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc, n, a, b (two hashes of the set), keys (of the first document with this set in a batch)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("jaccard", lambda: None)
        for batch in parts(batches, ROWS):
            a, b, keys, seen = [], [], [], set()
            sets = shingle_sets(batch.column(1), k)
            for x in sets:
                if not len(x):
                    a.append(None)
                    b.append(None)
                    keys.append(None)
                    continue
                a.append(int(mixed(x + _M2).sum().view(np.int64)))
                b.append(int(mixed(x ^ _M3).sum().view(np.int64)))
                new = (a[-1], b[-1]) not in seen
                seen.add((a[-1], b[-1]))
                keys.append(filed_keys(x, percent) if new else None)
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "a", "b", "keys"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc long, n long, a long, b long, keys array<long>")


class _Sets:
    """The sets of texts seen lately, by node."""

    def __init__(self, k: int, most: int = 2_000_000):
        self.k, self.most, self.held, self.total = k, most, {}, 0

    def get(self, node: int, text: str) -> np.ndarray:
        found = self.held.get((node, len(text)))
        if found is None or found[0] != text:
            if self.total > self.most:
                self.held.clear()
                self.total = 0
            found = self.held[node, len(text)] = (text, shingle_sets(pa.array([text]), self.k)[0])
            self.total += len(found[1])
        return found[1]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact, from sorted arrays of distinct shingles."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words for each set: bit h mod width is set for each shingle h. The width fits the largest set."""
    width = max(64, 1 << min(14, (2 * max(map(len, sets))).bit_length()))
    out = np.zeros((len(sets), width // 64), np.uint64)
    row = np.zeros(width, np.uint8)
    for k, x in enumerate(sets):
        row[:] = 0
        row[(x % np.uint64(width)).astype(np.int64)] = 1
        out[k] = np.packbits(row).view(np.uint64)
    return out


def tile_links(nodes: list[int], labels: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different labels that join what isn't joined yet. side: -1 all pairs, else only across 0 and 1."""
    order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
    size = np.array([len(sets[i]) for i in order])
    bits = bitmaps([sets[i] for i in order])
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    side = side[order]
    names, root = np.unique([labels[i] for i in order], return_inverse=True)
    out = []
    for i in range(len(order)):
        end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        later = np.arange(i + 1, end)
        later = later[(root[later] != root[i]) & ((side[i] < 0) | (side[later] != side[i]))]
        if not len(later):
            continue
        common = np.bitwise_count(bits[later] & bits[i]).sum(1, dtype=np.int64)
        bound = np.minimum(size[i] - (ones[i] - common), size[later] - (ones[later] - common))
        for j in later[100 * bound >= percent * (size[i] + size[later] - bound)].tolist():
            if root[i] != root[j] and similar(sets[order[i]], sets[order[j]], percent):
                out.append((nodes[order[i]], nodes[order[j]]))
                root[root == root[j]] = root[i]
    return out


def _large_tiles(large: DataFrame, percent: int) -> DataFrame:
    """node, block, label, tile, side of the tiles of large components of candidates.

    Nodes are numbered by component, size band, label and size in one sort over partitions, and each band is cut into blocks of so many nodes as
    its sizes allow. A band meets itself and the next one: sets in others differ too much in size. Pairs of blocks that
    both hold one and the same label are left out as ranges, so a component that is all but joined costs no pairs of its own blocks.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    placed = numbered(large.withColumn("band", band), ["block", "band", "label", "n", "node"], "blocks")
    if placed.limit(1).count() == 0:
        return large.select("node", "block", "label", F.lit(0).cast("long").alias("tile"), F.lit(0).alias("side")).limit(0)
    per = placed.groupBy("block", "band").agg(F.min("number").alias("begun"), F.max("n").alias("largest"))
    per = stored(per.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(BLOCK_NODES), F.floor(F.lit(BLOCK_SHINGLES) / F.col("largest"))))), "bands")
    cut = placed.join(sized_broadcast(per, per.count()), ["block", "band"]).withColumn("part", F.floor((F.col("number") - F.col("begun")) / F.col("width")))
    cut = stored(cut.select("node", "block", "band", "label", "part"), "parts")
    about = stored(cut.groupBy("block", "band", "part").agg(F.min("label").alias("l0"), F.max("label").alias("l1")), "about")
    last = about.groupBy("block", "band").agg(F.max("part").alias("last"))
    pure = about.where("l0 = l1").groupBy("block", "band", "l0").agg(F.min("part").alias("from"), F.max("part").alias("to"))
    i = about.withColumns({"l": F.when(F.col("l0") == F.col("l1"), F.col("l0")), "next": F.col("band") + 1})
    i = i.join(last, ["block", "band"]).join(pure.select("block", "band", F.col("l0").alias("l"), "to"), ["block", "band", "l"], "left")
    i = i.join(last.select("block", F.col("band").alias("next"), F.col("last").alias("last2")), ["block", "next"], "left")
    i = i.join(pure.select("block", F.col("band").alias("next"), F.col("l0").alias("l"), F.col("from").alias("from2"), F.col("to").alias("to2")), ["block", "next", "l"], "left")

    def span(low, high):
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    zero = F.lit(0).cast("long")
    own = span(F.when(F.col("l").isNull(), F.col("part")).otherwise(F.col("to") + 1), F.col("last"))
    beyond = F.when(F.col("last2").isNull(), F.array().cast("array<bigint>")).when(F.col("from2").isNull(), span(zero, F.col("last2"))).otherwise(F.concat(span(zero, F.col("from2") - 1), span(F.col("to2") + 1, F.col("last2"))))
    there = F.concat(F.transform(own, lambda x: F.struct(F.col("band").alias("band"), x.alias("part"))), F.transform(beyond, lambda x: F.struct(F.col("next").alias("band"), x.alias("part"))))
    tiles = i.select("block", "band", "part", F.explode(there).alias("o")).withColumn("tile", F.xxhash64("block", "band", "part", "o.band", "o.part"))
    alone = (F.col("band") == F.col("o.band")) & (F.col("part") == F.col("o.part"))

    def side(band, part, number):
        return F.struct(band.alias("band"), part.alias("part"), F.lit(number).alias("side"))

    both = F.array(side(F.col("band"), F.col("part"), 0), side(F.col("o.band"), F.col("o.part"), 1))
    sides = tiles.select("block", "tile", F.explode(F.when(alone, F.array(side(F.col("band"), F.col("part"), -1))).otherwise(both)).alias("s"))
    sides = sides.select("block", "tile", "s.band", "s.part", "s.side")
    return cut.join(sides, ["block", "band", "part"]).select("node", "block", "label", "tile", "side")


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest doc_id that links reach) of every row."""
    spark = docs.sparkSession
    keyed = stored(_signatures(docs, k, percent, id_col, text_col), "signatures")
    found = stored(keyed.select("doc", "n", "a", "b"), "sizes")
    sets = found.where(F.col("doc").isNotNull() & F.col("a").isNotNull()).groupBy("a", "b").agg(F.min("doc").alias("node"))
    sets = stored(sets, "sets")
    filed = keyed.where(F.size("keys") > 0).select("a", "b", "keys").join(sets, ["a", "b"])
    filing = filed.select(F.explode("keys").alias("key"), "node")
    heads = filing.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    # few keys are shared: where they are counted and few enough, the filing isn't shuffled a second time
    heads = stored(heads, "heads")
    pairs = stored(filing.join(sized_broadcast(heads, heads.count()), "key").where("head <> node").select("head", "node").distinct(), "candidates")
    discard(keyed, heads)
    free_shuffles(spark)
    block = connected_components(pairs.select(F.col("head").alias("u"), F.col("node").alias("v"))).select("node", F.col("component").alias("block"))
    n_nodes = block.count()

    # a node is a document, so its text is found by doc_id; texts travel, since they compress far better than hashes
    slim = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = stored(slim.join(sized_broadcast(block.select("node"), n_nodes), "node", "left_semi").distinct(), "texts")
    nearest = stored(pairs.groupBy("node").agg(F.min("head").alias("head")), "nearest")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("jaccard", lambda: None)
        seen = _Sets(k)
        for batch in parts(batches, ROWS):
            u, v, x, y = (batch.column(j).to_pylist() for j in range(4))
            good = pa.array([similar(seen.get(a, s), seen.get(b, t), percent) for a, b, s, t in zip(u, v, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    # texts of nodes that aren't compared don't travel
    first = nearest.select("head").distinct()
    a = held.select(F.col("node").alias("head"), F.col("text").alias("text_u")).join(sized_broadcast(first, n_nodes), "head", "left_semi")
    b = held.withColumnRenamed("text", "text_v").join(sized_broadcast(nearest, n_nodes), "node")
    compared = b.join(a, "head").select("head", "node", "text_u", "text_v")
    near = stored(compared.mapInArrow(verify, "u long, v long"), "near")
    joined = connected_components(near).select("node", F.col("component").alias("label"))

    labelled = stored(block.join(joined, "node", "left").select("node", "block", F.coalesce("label", "node").alias("label")), "labelled")
    open_ = labelled.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("block", "members")
    sizes = found.where("doc is not null").groupBy(F.col("doc").alias("node")).agg(F.max("n").alias("n"))
    rest = stored(labelled.join(open_, "block").join(sizes, "node"), "open")
    small = rest.where(F.col("members") <= BLOCK)
    tasks = max(1, -(-small.count() // GROUPED))
    tile_s = small.select("node", "block", "label", F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("tile"), F.lit(-1).alias("side"))
    tiles = stored(tile_s.unionByName(_large_tiles(rest.where(F.col("members") > BLOCK), percent)), "tiles")
    full = held.join(sized_broadcast(tiles, tiles.count()), "node")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        only_memo("jaccard", lambda: None)
        out = []
        for _, part in rows.groupby("block", sort=True):
            part = part.sort_values(["node", "text"])
            out += tile_links(part["node"].tolist(), part["label"].tolist(), shingle_sets(pa.array(part["text"], pa.large_string()), k), part["side"].to_numpy(), percent)
        release()
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    late = full.groupBy("tile").applyInPandas(settle, "u long, v long")

    # rows that share a doc_id are one document
    twice = found.where(F.col("doc").isNotNull() & F.col("a").isNotNull()).select("doc", "a", "b").distinct()
    many = twice.groupBy("doc").count().where("count > 1").select("doc")
    own = twice.join(many, "doc").join(sets, ["a", "b"]).select(F.col("doc").alias("u"), F.col("node").alias("v"))
    final = connected_components(near.unionByName(late).unionByName(own))
    discard(held, tiles, near, nearest, pairs, labelled, rest)
    free_shuffles(spark)
    named = found.select("doc", "n", "a", "b").join(sets, ["a", "b"], "left")
    labels = final.select(F.col("node").alias("_node"), "component")
    start = F.when(F.col("doc").isNotNull(), F.coalesce("node", "doc"))
    out = named.withColumn("_start", start).join(labels, F.col("_start") == F.col("_node"), "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_start").alias("component_id"))


#: Rows with a null doc_id get nodes from here up, by a hash of their text.
_NULL_IDS = 1 << 62


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, equal rows (by doc_id and text) once.

    A null doc_id counts as a node of its own for each text, above all ids, so it goes if it is like a document with an id.
    Rows with an empty set stay, but for repeats of a doc_id and text.
    """
    word = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = F.lit(_NULL_IDS) + F.pmod(F.xxhash64(text_col), F.lit(_NULL_IDS))
    marked = docs.withColumn("_node", F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("long")).when(word, own))
    found = similarity_components(marked.select("_node", text_col), k, percent, "_node", text_col)
    gone = stored(found.where(F.col("_node") != F.col("component_id")).select(F.col("_node").alias("_gone")).distinct(), "gone")
    repeats = marked.where(F.col("_node").isNotNull()).groupBy("_node", F.xxhash64(text_col).alias("_hash")).count().where("count > 1").select(F.col("_node").alias("_n"), F.col("_hash").alias("_h"))
    repeats = stored(repeats, "repeats")
    n_repeats = repeats.count()
    # texts don't travel: both tables hold ids alone and are broadcast where counted and few enough
    left = marked.join(sized_broadcast(gone, gone.count()), F.col("_node") == F.col("_gone"), "left_anti")
    if not n_repeats:
        return left.drop("_node")
    # only repeats are sorted out by their text; nulls among keys of repeats can't arise
    repeats = sized_broadcast(repeats, n_repeats)
    same = (F.col("_node") == F.col("_n")) & (F.xxhash64(text_col) == F.col("_h"))
    once = left.join(repeats, same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeats, same, "left_anti").unionByName(once).drop("_node")
