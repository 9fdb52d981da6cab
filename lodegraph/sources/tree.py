"""Sources of files: a tree, the files that a range of commits changes, and settings."""

from __future__ import annotations

import os
import subprocess
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import glob_regex, suffix
from ..operators.parse import LANGUAGES

# Folders and files that are left out wherever they are, and the languages that are read unless others are named.
IGNORED = (
    ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules", "vendor", "bower_components",
    ".venv", "venv", "env", "dist", "build", "out", ".next", ".nuxt", ".tox", ".eggs",
)
DEFAULT_LANGUAGES = ("python", "javascript", "typescript")


@dataclass
class Config:
    """Settings, of which languages and ignore_paths matter to indexing."""

    languages: tuple[str, ...] = DEFAULT_LANGUAGES
    ignore_paths: tuple[str, ...] = ()
    debounce_ms: int = 500
    other: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, section: str = "lodegraph") -> Config:
        """From a TOML file's section, nested or not; a missing file gives the defaults."""
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            data = tomllib.load(f).get(section, {})
        flat = data | {k: v for part in data.values() if isinstance(part, dict) for k, v in part.items()}
        known = {x.name for x in fields(cls)} - {"other"}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known}, other={k: v for k, v in flat.items() if k not in known and not isinstance(v, dict)})


def suffixes(languages: tuple[str, ...]) -> list[str]:
    """Of the languages named; if none of them is known, of all."""
    found = [s for n in languages for s in LANGUAGES.get(n, ())]
    return found or [s for group in LANGUAGES.values() for s in group]


def scan_tree(spark: SparkSession, root: str, config: Config | None = None, strict: bool = False) -> DataFrame:
    """path, content, last_modified of the source files below a folder that all executors see.

    Ignored names drop a file if any part of its path below the root is one. Bytes that aren't UTF-8 become replacement marks, or, if strict,
    drop the file. Line ends become line feeds.
    """
    config = config or Config()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/*", "/") if "://" not in root else F.col("path")
    found = files.select(path.alias("path"), "content", (F.unix_micros("modificationTime") / 1e6).alias("last_modified"))
    inside = F.expr(f"substring(path, {len(base) + 1})") if "://" not in root else F.col("path")
    kept = found.where(~F.arrays_overlap(F.split(inside, "/"), F.array(*map(F.lit, IGNORED)))).where(suffix(F.col("path")).isin(suffixes(config.languages)))
    for glob in config.ignore_paths:
        kept = kept.where(~F.col("path").rlike(glob_regex(glob)))
    raw = F.col("content").cast("string")
    if strict:
        kept = kept.where(F.is_valid_utf8(raw))
    text = F.regexp_replace(F.make_valid_utf8(raw), "\r\n?", "\n")
    return kept.select("path", text.alias("content"), "last_modified")


def in_order(files: DataFrame) -> DataFrame:
    """By path components."""
    return files.orderBy(F.split("path", "/"))


def git_changes(spark: SparkSession, repo: str, commits: str) -> DataFrame:
    """file_path, before, after of files that differ between a range A..B (or R~1 and R) and the folder. Read by the driver: a checkout is local."""
    left = commits.split("..")[0] if ".." in commits else f"{commits}~1"
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], capture_output=True)
    rows = []
    for name in run("diff", "--name-only", commits).stdout.decode("utf-8", "replace").splitlines():
        at = os.path.join(repo, name)
        if os.path.isfile(at):
            before = run("show", f"{left}:{name}")
            with open(at, encoding="utf-8", errors="replace") as f:
                rows.append((name, before.stdout.decode("utf-8", "replace") if not before.returncode else "", f.read()))
    return spark.createDataFrame(rows, "file_path string, before string, after string")
