"""Removal of lines that many sites share, by sketches of distinct sites with exact counts near the threshold.

A line counts by its trimmed text; blank ones don't. Two 64-bit hashes name it. How many sites make it shared depends on its words: `min_sites`
from `min_words` words on, `short_sites` below, and for lines of `long_words` and more `long_sites`, where each distinct text is a
site of its own, so that a long passage is found even if it repeats inside one source, and copies of a whole text stay whole. Each line's HyperLogLog sketch
of distinct sites merges in the aggregation by line. An estimate clearly below or above the threshold decides;
within the sketch's error of it the distinct (line, site) pairs are counted exactly. A shared line then stays
in the document with the smallest doc_id that holds it (a long one in copies of that text, too) and goes from all others. DataFrame functions only.

Lines that hold more than one in HOT_SHARE of all occurrences, so at most HOT_SHARE lines, meet their occurrences in a broadcast join; no
other line has enough of them to fill a task. What goes from a document is a set of line numbers.

Nulls: a null text keeps null; a null site counts as one site of its own; a null doc_id never counts as the first unless
no holder has one. Rows that share a doc_id are treated alike. A document that loses all lines keeps an empty text. Extra columns
of the input are ignored, and an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, stored

MIN_SITES = 3
MIN_WORDS = 5
SHORT_SITES = 10
LONG_WORDS, LONG_SITES = 50, 2
#: Binary logarithm of the buckets of a sketch: a relative standard error of about 1.6 %, far less for a few sites.
LG_BUCKETS = 12
#: Estimates within this share of the threshold are counted exactly: over four standard errors, and at least one site.
NEAR = 0.07
#: Lines that may be broadcast, at most: each has more than this share of all occurrences.
HOT_SHARE = 10_000
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _words(line, least: int):
    """Whether a line has so many words."""
    return line.rlike(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){%d}" % least)


def occurrences(docs: DataFrame, id_col: str, site_col: str, text_col: str, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, short_sites: int = SHORT_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> DataFrame:
    """Lines that aren't blank: a, b (hashes), doc, row (a hash of the text), at (line number from 0), site, need (sites that make it shared)."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), site.alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    line = F.regexp_replace("line", _TRIM, "")
    long = (F.length("line") >= 2 * long_words - 1) & _words(F.col("line"), long_words)
    need = F.when(F.col("long"), long_sites).when(_words(F.col("line"), min_words), min_sites).otherwise(short_sites)
    named = rows.select("doc", "row", "at", "site", line.alias("line")).where("line <> ''").withColumn("long", long).withColumn("need", need)
    return named.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"), "doc", "row", "at", F.when(F.col("long"), F.col("row").cast("string")).otherwise(F.col("site")).alias("site"), "need", "long")


def shared_lines(found: DataFrame, lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """Lines on as many sites as they need: a, b, first (the smallest doc that holds it and, of a long line, its text's hash), n (occurrences)."""
    sketched = found.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_buckets))).alias("sites"), F.min_by(F.struct("doc", F.when(F.col("long"), F.col("row")).alias("row")), F.struct(F.col("doc").isNull(), "doc", "row")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    slack = F.greatest(F.lit(1.0), F.lit(NEAR) * F.col("need"))
    likely = sketched.where((F.col("n") >= F.col("need")) & (F.col("sites") >= F.col("need") - slack))
    columns = ["a", "b", "first", "n"]
    clear = likely.where(F.col("sites") > F.col("need") + slack).select(*columns)
    near = likely.where(F.col("sites") <= F.col("need") + slack).select(*columns, "need")
    pairs = found.groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(near, ["a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"), F.first("first").alias("first"), F.max("n").alias("n"), F.max("need").alias("need"))
    return clear.unionByName(exact.where(F.col("sites") >= F.col("need")).select(*columns))


def shared_occurrences(found: DataFrame, shared: DataFrame) -> DataFrame:
    """doc, row, at of the occurrences of shared lines outside their first document."""
    shared = stored(shared, "shared-lines")
    total = found.count()
    hot = shared.where(F.col("n") * HOT_SHARE > total).select("a", "b", "first")
    cold = shared.where(F.col("n") * HOT_SHARE <= total).select("a", "b", "first")
    # the hot ones leave before the shuffle: at most HOT_SHARE rows of three numbers are broadcast
    marked = found.join(F.broadcast(hot.select("a", "b", F.col("first").alias("_first"), F.lit(True).alias("_hot"))), ["a", "b"], "left")
    rest = marked.where("_hot is null").select("a", "b", "doc", "row", "at").join(cold, ["a", "b"])
    both = marked.where("_hot").select("doc", "row", "at", F.col("_first").alias("first")).unionByName(rest.select("doc", "row", "at", "first"))
    return both.where(~F.col("doc").eqNullSafe(F.col("first.doc")) & ~F.coalesce(F.col("row") == F.col("first.row"), F.lit(False))).select("doc", "row", "at")


def remove_shared_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", extra: tuple[str, ...] = (), short_sites: int = SHORT_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES
) -> DataFrame:
    """id_col, text_col without its shared lines, n_lines, n_removed, and the columns in extra as they were."""
    # written once: a few bytes for each line, read three times
    found = stored(occurrences(docs, id_col, site_col, text_col, min_sites, min_words, short_sites, long_words, long_sites), "lines")
    gone = stored(shared_occurrences(found, shared_lines(found)), "gone-lines")
    discard(found)
    free_shuffles(docs.sparkSession)
    by_row = gone.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("at").alias("_gone"))
    rows = docs.select(F.col(id_col), F.col(text_col), *(F.col(x) for x in extra))
    joined = rows.join(by_row, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(text_col) == F.col("_row")), "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda k: F.get(lines, k))
    return joined.select(
        F.col(id_col),
        F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")).alias(text_col),
        *(F.col(x) for x in extra),
        F.coalesce(F.size(lines).cast("long"), F.lit(0)).alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
