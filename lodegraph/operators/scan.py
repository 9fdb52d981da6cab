"""Line scanning with rules, statuses, and the findings that a change introduces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import splitlines, stripped
from .rules import RULES, Rule

_RANK = {"INFO": 0, "WARN": 1, "BLOCK": 2}


def _may_match(text: Column, rules: list[Rule]) -> Column:
    """Whether a text holds a piece that some rule needs: a plain substring test. Rules that name no piece are always tried."""
    if any(not r.needs for r in rules):
        return F.lit(True)
    found = F.lit(False)
    for piece in sorted({x for r in rules for x in r.needs}):
        found = found | F.contains(text, F.lit(piece))
    return found


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES, detectors: tuple[str, ...] | None = None, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """One finding for each line and rule that matches, however often. A null text has no lines.

    Rules name pieces of text of which every match holds one. A file is split into lines only if it holds a piece of some rule, a line goes on
    only if it does, and a rule's pattern is tried only on lines with a piece of its own: each pattern is a literal, compiled
    once, and no line is paired with a rule that it doesn't meet.
    """
    used = [(k, r) for k, r in enumerate(rules) if detectors is None or r.detector in detectors]
    some = [r for _, r in used]
    held = files.select(F.col(path_col).alias("file_path"), F.col(text_col).alias("_text")).where(_may_match(F.col("_text"), some))
    lines = held.select("file_path", F.posexplode(splitlines(F.col("_text"))).alias("at", "line")).where(_may_match(F.col("line"), some))
    tried = [F.when(_may_match(F.col("line"), [r]) & F.col("line").rlike("(?U)" + r.pattern), F.lit(k)).otherwise(-1) for k, r in used]
    # an outer explode, since the filter that the planner infers for an inner one would try all patterns twice
    rows = lines.select("file_path", (F.col("at") + 1).alias("line_number"), "line", F.explode_outer(F.array_remove(F.array(*tried), -1) if tried else F.array().cast("array<int>")).alias("rule")).where("rule is not null")
    texts = {c: F.element_at(F.create_map(*(x for k, r in used for x in (F.lit(k), F.lit(getattr(r, c))))), F.col("rule")) for c in ("severity", "description", "fix_suggestion", "detector")}
    return rows.select("file_path", "line_number", texts["severity"].alias("severity"), texts["detector"].alias("category"), texts["description"].alias("description"), texts["fix_suggestion"].alias("fix_suggestion"), texts["detector"].alias("detector"), "rule", "line")


def status_of(severity: Column) -> Column:
    """An aggregate: BLOCK if any blocks, else WARN if any warns, else PASS."""
    return F.when(F.bool_or(severity == "BLOCK"), "BLOCK").when(F.bool_or(severity == "WARN"), "WARN").otherwise("PASS")


def report(files: DataFrame, findings: DataFrame, path_col: str = "file_path") -> DataFrame:
    """file_path, status, n_issues, is_blocked, has_warnings of every file, also without findings."""
    by = findings.groupBy("file_path").agg(status_of(F.col("severity")).alias("status"), F.count(F.lit(1)).alias("n_issues"))
    out = files.select(F.col(path_col).alias("file_path")).distinct().join(by, "file_path", "left")
    status = F.coalesce("status", F.lit("PASS"))
    return out.select("file_path", status.alias("status"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (status == "BLOCK").alias("is_blocked"), status.isin("WARN", "BLOCK").alias("has_warnings"))


def scan_diff(changes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of `after` whose (description, stripped line) isn't among those of `before`, by file_path. Null texts have no lines."""
    old = scan(changes, rules, text_col="before").select(F.col("file_path").alias("_path"), F.col("description").alias("_d"), stripped(F.col("line")).alias("_l")).distinct()
    new = scan(changes, rules, text_col="after").withColumn("_line", stripped(F.col("line")))
    same = (F.col("file_path") == F.col("_path")) & (F.col("description") == F.col("_d")) & (F.col("_line") == F.col("_l"))
    return new.join(old, same, "left_anti").drop("_line")


def check_writes(proposals: DataFrame, current: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings that proposals (file_path, after) would add to the current texts (file_path, content); a missing file is empty."""
    changes = proposals.join(current.select("file_path", F.col("content").alias("before")), "file_path", "left")
    return scan_diff(changes.select("file_path", F.coalesce("before", F.lit("")).alias("before"), "after"), rules)


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in _RANK.items() for x in pair)), severity)
