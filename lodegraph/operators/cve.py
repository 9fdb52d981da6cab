"""Requirements against a table of advisories: the network look-up as a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import splitlines, stripped

# Severities in ascending order, and how many ids are shown.
ORDER = ("UNKNOWN", "PASS", "LOW", "MEDIUM", "HIGH", "CRITICAL")
MOST_IDS = 10


def requirements(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """package, from requirement files: blank lines, comments, options and links are left out; the name ends at [ or a version mark."""
    line = stripped(F.col("line"))
    rows = texts.select(F.explode(splitlines(F.col(text_col))).alias("line")).select(line.alias("line"))
    kept = rows.where((F.col("line") != "") & ~F.col("line").rlike("^[#-]") & ~F.col("line").contains("://"))
    name = stripped(F.regexp_extract("line", r"^(.*?)(\[|>=|<=|==|!=|~=|$)", 1))
    return kept.select(name.alias("package")).where("package <> ''")


def check(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """package, severity (the worst; PASS without any), cve_ids (at most 10, sorted). advisories: package, cve_id, severity."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.upper("severity")), F.lit(3)).cast("int")
    ids = F.array_sort(F.collect_set(F.when(F.col("cve_id").startswith("CVE-"), F.col("cve_id"))))
    worst = advisories.groupBy("package").agg(F.max(F.greatest(rank, F.lit(3))).alias("_rank"), F.slice(ids, 1, MOST_IDS).alias("cve_ids"))
    joined = packages.select("package").distinct().join(worst, "package", "left")
    return joined.select("package", F.when(F.col("_rank").isNull(), "PASS").otherwise(F.element_at(F.array(*map(F.lit, ORDER)), F.col("_rank"))).alias("severity"), F.coalesce("cve_ids", F.expr("cast(array() as array<string>)")).alias("cve_ids"))


def vulnerable(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("severity").isin("PASS", "UNKNOWN"))


def status(checked: DataFrame) -> DataFrame:
    """One row: BLOCK if any is critical, WARN if any is high, else PASS."""
    any_of = lambda s: F.coalesce(F.bool_or(F.col("severity") == s), F.lit(False))
    return checked.agg(F.when(any_of("CRITICAL"), "BLOCK").when(any_of("HIGH"), "WARN").otherwise("PASS").alias("status"))
