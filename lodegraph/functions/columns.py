"""Column expressions that the operators share: ids, paths, lines, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where Python's str.splitlines breaks lines.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: White space as Python's str.strip takes it.
_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def file_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("file:"), path), 256)


def symbol_id(path: Column, name: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, name, kind), 256)


def edge_id(from_id: Column, to_id: Column, kind: Column, line: Column) -> Column:
    """A null line reads as None in the id."""
    return F.sha2(F.concat_ws(":", from_id, to_id, kind, F.coalesce(line.cast("string"), F.lit("None"))), 256)


def checksum(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def line_count(text: Column) -> Column:
    """Line feeds and one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower case, with its dot; empty for names without one or that only start with one."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=[^.])(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def splitlines(text: Column) -> Column:
    """The lines of a text as an array; an empty text has none."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def glob_regex(glob: str) -> str:
    """A shell pattern over whole paths as a Java regular expression; * and ? cross slashes."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and (end := glob.find("]", k + 1 + (glob[k : k + 1] == "!"))) > 0:
            inner = glob[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += f"[{'^' + inner[1:] if inner.startswith('!') else inner}]"
            k = end + 1
        else:
            out += re.sub(r"([^\w\s/])", r"\\\1", c)
    return f"(?s)^{out}$"


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))
