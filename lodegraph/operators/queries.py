"""Aggregations and composite queries over files, symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename, plural, stem
from . import graph, lookups

# How many rows the composite answers show.
CALLERS, CALLEES, TYPES, VARIABLES = 20, 20, 10, 10
TRANSITIVE, KEY_CLASSES, FLOW_PATHS, NAMES = 100, 5, 5, 3
#: Impact is critical above 20, high above 10, medium above 3.
CRITICAL, HIGH, MEDIUM = 20, 10, 3
#: Estimated tokens of a context: a base, and a share for the symbol and each distinct caller or callee.
BASE_TOKENS, TOKENS_EACH = 200, 50


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts. Symbols of other kinds than the four are not counted; coverage is in percent of files, 0.0 without any."""
    kinds = {"function_count": "function", "class_count": "class", "variable_count": "variable", "import_count": "import"}
    s = symbols.agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()), F.count_distinct("file_id").alias("covered"))
    f = files.agg(F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_set("language")).alias("languages"), F.max("indexed_at").alias("indexed_at"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    coverage = F.when(F.col("file_count") > 0, F.round(F.col("covered") / F.col("file_count") * 100, 1)).otherwise(0.0)
    return f.crossJoin(s).crossJoin(e).select("file_count", *kinds, "edge_count", "languages", "indexed_at", coverage.alias("coverage_percent"))


def index_totals(stat: DataFrame) -> DataFrame:
    total = F.col("function_count") + F.col("class_count") + F.col("variable_count") + F.col("import_count")
    return stat.select("file_count", total.alias("symbol_count"), "edge_count")


def file_map(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each file, also without symbols: counts and a role in words."""
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "class").alias("c"), F.count_if(F.col("kind") == "function").alias("f"))
    joined = files.join(counts, F.col("id") == F.col("file_id"), "left")
    n, c, f = (F.coalesce(F.col(x), F.lit(0)).cast("long") for x in "ncf")
    said = F.concat_ws(", ", F.when(c > 0, plural(c, "class", "classes")), F.when(f > 0, plural(f, "function", "functions")))
    role = F.concat(basename(F.col("path")), F.lit(": "), F.when(said == "", "source file").otherwise(said))
    return joined.select("path", F.coalesce("language", F.lit("")).alias("language"), F.col("line_count").alias("lines"), n.alias("symbol_count"), c.alias("class_count"), f.alias("function_count"), role.alias("role"))


def severity(n: Column, public_api: Column) -> Column:
    return F.when(public_api | (n > CRITICAL), "CRITICAL").when(n > HIGH, "HIGH").when(n > MEDIUM, "MEDIUM").otherwise("LOW")


def impact_counts(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kind: str | None = "calls") -> DataFrame:
    """For each seed (id, is_public): direct callers, surface (all dependents, ghosts and files among them), severity.

    One loop for all seeds. Seeds without dependents stay, as LOW.
    """
    used = edges.where(F.col("kind") == kind) if kind else edges
    direct = used.select(F.col("to_id").alias("id"), "from_id").distinct().join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("direct"))
    surface = graph.reach(edges, seeds.select("id"), "dependents").groupBy("source").agg(F.count(F.lit(1)).alias("surface"))
    joined = seeds.join(direct, "id", "left").join(surface, F.col("id") == F.col("source"), "left")
    d, s = F.coalesce("direct", F.lit(0)), F.coalesce("surface", F.lit(0))
    public = F.col("is_public") & (d > 0)
    return joined.select("id", d.alias("direct"), s.alias("surface"), public.alias("public_api"), severity(s, public).alias("severity"))


def impact(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str, name: str) -> DataFrame:
    """One row for a symbol, none if it is missing. The list of dependents is cut to the first 100 by (path, ordinal, id); test files come from those."""
    seed = lookups.find_symbol(files, symbols, path, name).select("id", "is_public", F.col("name").alias("symbol"))
    ids = graph.reach(edges, seed.select("id")).select("id")
    counts = impact_counts(symbols, edges, seed.select("id", "is_public"))
    where = files.select(F.col("id").alias("file_id"), "path")
    direct = graph.callers(edges, symbols).join(seed.select("id"), "id").select(F.col("caller").alias("id"))
    named = lambda d: d.join(symbols, "id").join(where, "file_id", "left").orderBy(F.coalesce("path", F.lit("")), "ordinal", "id")
    top = named(ids).limit(TRANSITIVE).select("name", F.coalesce("path", F.lit("")).alias("path"))
    listed = named(direct).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("path", F.lit("")).alias("path"), "ordinal", "id", "name"))).alias("x"))
    lists = listed.select(F.transform("x", lambda s: s["name"]).alias("direct_callers")).crossJoin(
        top.agg(F.collect_list("name").alias("dependents"), F.array_sort(F.collect_set(F.when(F.lower("path").contains("test"), F.col("path")))).alias("affected_test_files")))
    return seed.select("id", "symbol").join(counts, "id").crossJoin(lists)


def contexts(files: DataFrame, symbols: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """For each seed (id): names of callers and callees up to 20, of types and variables within depth hops up to 10, estimated tokens.

    All seeds go at once; only types and variables are followed on the last hop.
    """
    one = seeds.select("id").distinct()
    of = lambda pairs, c, role: pairs.join(one, "id", "left_semi").select("id", F.col(c).alias("other"), F.lit(role).alias("role"))
    up, down = of(graph.callers(edges, symbols), "caller", "callers"), of(graph.callees(edges, symbols), "callee", "callees")
    rows = up.unionByName(down)
    wanted = symbols.where(F.col("kind").isin("type", "variable")).select(F.col("id").alias("b"), F.concat("kind", F.lit("s")).alias("role"))
    if depth > 0:
        inner = graph.reach(edges, one, "both", depth - 1).select("source", "id") if depth > 1 else None
        near = one.select(F.col("id").alias("source"), "id")
        near = near.unionByName(inner) if inner is not None else near
        step = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(edges.select("to_id", "from_id")).distinct().join(wanted, "b")
        last = near.join(step, F.col("id") == F.col("a")).select(F.col("source").alias("id"), F.col("b").alias("other"), "role")
        rows = rows.unionByName(last.where("id <> other").distinct())
    most = F.element_at(F.create_map(*(F.lit(x) for x in ("callers", CALLERS, "callees", CALLEES, "types", TYPES, "variables", VARIABLES))), F.col("role"))
    where = files.select(F.col("id").alias("file_id"), "path")
    about = symbols.select(F.col("id").alias("other"), "name", "ordinal", "file_id").join(where, "file_id", "left")
    order = ["path", "ordinal", "other"]
    rank = F.row_number().over(Window.partitionBy("id", "role").orderBy(*order))
    top = rows.join(about, "other").withColumn("_rank", rank).where(F.col("_rank") <= max(CALLERS, CALLEES, TYPES, VARIABLES)).where(F.col("_rank") <= most)
    listed = top.groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("_rank", "name")))).alias(r) for r in ("callers", "callees", "types", "variables")))
    linked = rows.where("role IN ('callers', 'callees')").groupBy("id").agg(F.count_distinct("other").alias("n"), F.count_if(F.col("role") == "callers").alias("n_callers"), F.count_if(F.col("role") == "callees").alias("n_callees"))
    got = one.join(listed, "id", "left").join(linked, "id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    names = [F.coalesce(F.transform(r, lambda x: x["name"]), F.expr("cast(array() as array<string>)")).alias(r) for r in ("callers", "callees", "types", "variables")]
    return got.select("id", *names, z("n_callers").alias("n_callers"), z("n_callees").alias("n_callees"), (BASE_TOKENS + TOKENS_EACH * (1 + z("n"))).cast("bigint").alias("estimated_tokens"))


def context(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str, name: str, depth: int = 2) -> DataFrame:
    """One row for a symbol: what `contexts` gives, and the symbol's own attributes."""
    seed = lookups.find_symbol(files, symbols, path, name)
    own = seed.select("id", F.col("name").alias("symbol"), "kind", "signature", "docstring", "line_start", "line_end", "complexity_score")
    return own.join(contexts(files, symbols, edges, seed.select("id"), depth).drop("n_callers", "n_callees"), "id").drop("id")


def callers_of(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str, name: str) -> DataFrame:
    one = lookups.find_symbol(files, symbols, path, name).select("id")
    return graph.callers(edges, symbols).join(one, "id").select(F.col("caller").alias("id")).join(symbols, "id")


def callees_of(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str, name: str) -> DataFrame:
    one = lookups.find_symbol(files, symbols, path, name).select("id")
    return graph.callees(edges, symbols).join(one, "id").select(F.col("callee").alias("id")).join(symbols, "id")


def import_scope(symbols: DataFrame) -> DataFrame:
    """file_id, name, ordinal, internal of every import: internal if another file has a symbol of that name that isn't an import.

    A name's files are counted and the own file's share subtracted, so no name is paired with all of its files.
    """
    real = symbols.where(F.col("kind") != "import").select("name", "file_id").distinct()
    spread = real.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    own = real.withColumn("own", F.lit(1))
    imports = symbols.where(F.col("kind") == "import").select("file_id", "name", "ordinal")
    joined = imports.join(spread, "name", "left").join(own, ["name", "file_id"], "left")
    return joined.select("file_id", "name", "ordinal", (F.coalesce("files", F.lit(0)) - F.coalesce("own", F.lit(0)) > 0).alias("internal"))


def dependencies(files: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """One row: internal and external import names in order, repeats kept. circular_deps stays empty."""
    one = lookups.file_by_path(files, path).select(F.col("id").alias("file_id"), "path")
    rows = import_scope(symbols).join(one.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "internal"))).alias("x"))
    named = lambda keep: F.transform(F.filter("x", lambda s: s["internal"] == keep), lambda s: s["name"])
    got = one.join(rows, "file_id", "left").withColumn("x", F.coalesce("x", F.expr("cast(array() as array<struct<ordinal:int,name:string,internal:boolean>>)")))
    return got.select("path", named(True).alias("internal"), named(False).alias("external"), F.expr("cast(array() as array<string>)").alias("circular_deps"))


def circular_files(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path) of files that depend on themselves through others: an extension.

    Files without links in or out are on no cycle and are trimmed until none is left; then the smallest file that reaches a file forwards and the
    smallest backwards are passed along. Where both agree, the file is on a cycle with that one, which is taken out with all that agree.
    """
    of = symbols.select("id", "file_id").union(files.select("id", F.col("id").alias("file_id")))
    a, b = of.select(F.col("id").alias("from_id"), F.col("file_id").alias("f")), of.select(F.col("id").alias("to_id"), F.col("file_id").alias("t"))
    links = edges.where("kind <> 'defines'").join(a, "from_id").join(b, "to_id").where("f <> t").select(F.col("f").alias("a"), F.col("t").alias("b")).distinct()
    return graph.on_cycles(links).join(files, "id").select("path")


def dependents_of(files: DataFrame, symbols: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path, dependent): for each file of seeds (id), the other files with a symbol that depends on one of its symbols."""
    asked = seeds.select(F.col("id").alias("_file")).distinct()
    own = symbols.select(F.col("file_id").alias("source"), "id").join(asked, F.col("source") == F.col("_file")).drop("_file")
    ids = graph.reach(edges, own).select("source", "id")
    found = ids.join(symbols.select("id", "file_id"), "id").select("source", "file_id").where("source <> file_id").distinct()
    a, b = files.select(F.col("id").alias("source"), "path"), files.select(F.col("id").alias("file_id"), F.col("path").alias("dependent"))
    return found.join(a, "source").join(b, "file_id").select("path", "dependent")


def dependents(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(path) of the other files with a symbol that depends on one of this file's."""
    return dependents_of(files, symbols, edges, lookups.file_by_path(files, path)).select(F.col("dependent").alias("path")).orderBy("path")


def flows(symbols: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, role, other, name, pos, on_path) for each seed (id): sources are callers, sinks callees, up to 20 each in the order of (ordinal, id);
    the first five of each make a path with the symbol. Each task keeps only the first 20 of a hub before they are dealt by seed."""
    one = seeds.select("id").distinct()
    order = Window.partitionBy("id", "role").orderBy("ordinal", "other")
    up = graph.callers(edges, symbols).select("id", F.col("caller").alias("other"), F.lit("source").alias("role"))
    down = graph.callees(edges, symbols).select("id", F.col("callee").alias("other"), F.lit("sink").alias("role"))
    both = up.unionByName(down).join(one, "id", "left_semi").join(symbols.select(F.col("id").alias("other"), "name", "ordinal"), "other")
    ranked = both.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max(CALLERS, CALLEES))
    kept = ranked.where(F.col("pos") <= F.when(F.col("role") == "source", CALLERS).otherwise(CALLEES))
    return kept.select("id", "role", "other", "name", "pos", (F.col("pos") <= FLOW_PATHS).alias("on_path"))


def data_flow(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str, name: str) -> DataFrame:
    """(role, name, pos, on_path) of one symbol, as `flows` gives them."""
    return flows(symbols, edges, lookups.find_symbol(files, symbols, path, name)).select("role", "name", "pos", "on_path")


def module_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each file: purpose, public names, imports, mean complexity of functions that have one, key classes, test file.

    The test file is the first other path whose lower-cased base name contains test_STEM or STEM_test. Candidates are found by those
    stems of test files that are pieces of the name, by an equality join, not by comparing all pairs.
    """
    public = F.col("is_public") & F.col("kind").isin("function", "class")
    span = F.col("line_end") - F.col("line_start")
    item = lambda when, *cols: F.array_sort(F.collect_list(F.when(when, F.struct(*cols))))
    agg = symbols.groupBy("file_id").agg(
        item(F.col("kind") == "class", "ordinal", "name").alias("classes"),
        item(public & (F.col("kind") == "function"), "ordinal", "name").alias("functions"),
        item(public, "ordinal", "name").alias("api"),
        item(F.col("kind") == "import", "ordinal", "name").alias("imports"),
        item(F.col("kind") == "class", (-span).alias("span"), "ordinal", "name").alias("largest"),
        F.avg(F.when((F.col("kind") == "function") & (F.col("complexity_score") != 0), F.col("complexity_score"))).alias("mean"),
    )
    n = lambda c, most=None: F.transform(F.slice(c, 1, most) if most else F.col(c), lambda s: s["name"])
    defined = F.array_join(n("classes", NAMES), ", ")
    given = F.array_join(n("functions", NAMES), ", ")
    said = F.concat_ws("; ", F.when(defined != "", F.concat(F.lit("defines "), defined)), F.when(given != "", F.concat(F.lit("provides "), given)))
    own = stem(F.col("path"))
    purpose = F.when(F.coalesce(said, F.lit("")) == "", F.concat(F.lit("Module "), own, F.lit(": source module."))).otherwise(F.concat(F.lit("Module "), own, F.lit(": "), said, F.lit(".")))
    tests = _test_files(files)
    out = files.join(agg, F.col("id") == F.col("file_id"), "left").join(tests, "path", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        "path", purpose.alias("purpose"), F.coalesce(n("api"), none).alias("public_api"), F.coalesce(n("imports"), none).alias("dependencies"),
        F.round(F.coalesce("mean", F.lit(0.0)), 2).alias("complexity"), F.coalesce(n("largest", KEY_CLASSES), none).alias("key_classes"), "test_file",
    )


def _test_files(files: DataFrame) -> DataFrame:
    """(path, test_file). Every end of a name after test_ and every start before _test is a possible stem."""
    low = F.lower(basename(F.col("path")))
    heads = F.transform(F.regexp_extract_all(low, F.lit("(?=test_(.*))"), F.lit(1)), lambda x: x)
    after = F.flatten(F.transform(heads, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda k: F.substring(x, F.lit(1), k))))
    tails = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.when(F.substring(low, k, F.lit(5)) == "_test", F.substring(low, F.lit(1), k - 1))), lambda x: x.isNotNull())
    before = F.flatten(F.transform(tails, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda k: F.substring(x, k, F.length(x)))))
    tests = files.where(low.contains("test")).select(F.col("path").alias("test_file"), F.explode(F.array_distinct(F.concat(after, before))).alias("stem"))
    owners = files.select("path", stem(F.col("path")).alias("stem"))
    return owners.join(tests, "stem").where(F.col("path") != F.col("test_file")).groupBy("path").agg(F.min(F.struct(F.split("test_file", "/").alias("parts"), "test_file")).alias("t")).select("path", F.col("t.test_file").alias("test_file"))
