"""Graph operators over two tables: nodes (id, kind, ...) and edges (id, kind, from_id, to_id, ...).

Edges may point at ids without a node; such ghosts count in closures and node counts. Traversals are loops over the new
frontier only: each round joins it to the edges, drops what was seen, and is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import basename
from ..plans.storage import cut

#: After this many hops without an end, hops are doubled as long as walks stay few.
DEEP = 32


def edges_of(edges: DataFrame, ids: DataFrame, end: str, kind: str | None = None) -> DataFrame:
    """Edges whose `end` (from_id or to_id) is in ids (column id), of one kind if given."""
    found = edges.where(F.col("kind") == kind) if kind else edges
    return found.join(ids.select(F.col("id").alias("_id")).distinct(), F.col(end) == F.col("_id"), "left_semi")


def callers(edges: DataFrame, symbols: DataFrame, kind: str = "calls") -> DataFrame:
    """(id, caller) distinct: symbols with a calling edge to id."""
    pairs = edges.where(F.col("kind") == kind).select(F.col("to_id").alias("id"), F.col("from_id").alias("caller")).distinct()
    return pairs.join(symbols.select(F.col("id").alias("caller")), "caller", "left_semi").select("id", "caller")


def callees(edges: DataFrame, symbols: DataFrame, kind: str = "calls") -> DataFrame:
    """(id, callee) distinct: symbols that id has a calling edge to."""
    pairs = edges.where(F.col("kind") == kind).select(F.col("from_id").alias("id"), F.col("to_id").alias("callee")).distinct()
    return pairs.join(symbols.select(F.col("id").alias("callee")), "callee", "left_semi").select("id", "callee")


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "dependents", depth: int | None = None) -> DataFrame:
    """(source, id, hops): every id that each seed reaches, within depth hops if given, the source itself left out even on a cycle.

    seeds: id, and source if several ids start under one name. direction: dependents goes against the edges, dependencies along
    them, both ignores direction. All seeds go at once, each row keyed by its source, so many closures cost one loop. A hub that many edges meet
    is split by the adaptive join. Each hop is one round; a graph that is deeper than DEEP hops is then crossed by walks of 2, 4, 8 ... edges.
    """
    along = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    against = along.select(F.col("b").alias("a"), F.col("a").alias("b"))
    step = {"dependencies": along, "dependents": against, "both": along.unionByName(against)}[direction]
    step = cut(step.where("a <> b").distinct())
    start = seeds if "source" in seeds.columns else seeds.withColumn("source", F.col("id"))
    frontier = cut(start.select("source", "id").distinct())
    seen, hop = frontier.withColumn("hops", F.lit(0)), 0
    while depth is None or hop < depth:
        if hop and hop % DEEP == 0 and depth is None:
            seen = cut(seen)
            ahead, far = _doubled(step, frontier, seen)
            seen, hop = cut(seen.unionByName(ahead.withColumn("hops", F.col("hops") + hop))), hop + far
            frontier = seen.where(F.col("hops") == hop).select("source", "id")
            if frontier.isEmpty():
                break
        hop += 1
        new = frontier.join(step, F.col("id") == F.col("a")).select("source", F.col("b").alias("id")).distinct()
        frontier = cut(new.join(seen.select("source", "id"), ["source", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
        if hop % 8 == 0:
            seen = cut(seen)
    return seen.where(F.col("hops") > 0).where("source <> id")


def _doubled(step: DataFrame, frontier: DataFrame, seen: DataFrame) -> tuple[DataFrame, int]:
    """What lies up to `far` hops beyond the frontier and isn't seen: source, id, hops from the frontier; and far.

    Walks of exactly n edges, squared each round, take what is within n hops to all within 2 n. It stops at the end of the graph, or as soon as
    there are several times more such walks than edges.
    """
    walks, n, most = step, 1, 4 * step.count()
    found = frontier.withColumn("hops", F.lit(0))
    while True:
        longer = found.join(walks, F.col("id") == F.col("a")).select("source", F.col("b").alias("id"), (F.col("hops") + n).alias("hops"))
        new = longer.groupBy("source", "id").agg(F.min("hops").alias("hops")).join(seen.select("source", "id"), ["source", "id"], "left_anti").join(found.select("source", "id"), ["source", "id"], "left_anti")
        new = cut(new)
        found, ended = found.unionByName(new), new.isEmpty()
        n *= 2
        if not ended:
            found = cut(found)
            walks = cut(walks.alias("x").join(walks.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).where("a <> b").distinct())
        if ended or walks.count() > most:
            return found.where(F.col("hops") > 0), n - 1


def on_cycles(links: DataFrame) -> DataFrame:
    """(id) of nodes on a cycle of links (a, b), by trimming and colouring, without closures of all pairs."""
    found = links.select(F.col("a").alias("id")).limit(0)
    step = cut(links.where("a <> b").distinct())
    while True:
        before = -1
        while (n := step.count()) != before:  # a node without a link in or out is on no cycle
            before = n
            ins, outs = step.select(F.col("b").alias("_i")).distinct(), step.select(F.col("a").alias("_o")).distinct()
            step = cut(step.join(ins, F.col("a") == F.col("_i"), "left_semi").join(outs, F.col("b") == F.col("_o"), "left_semi"))
        if not n:
            return found
        forward, backward = _coloured(step, "a", "b"), None
        # backwards only along links inside one colour
        inside = step.join(forward.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(forward.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b")
        backward = _coloured(cut(inside), "b", "a")
        core = forward.join(backward.select("id", F.col("colour").alias("back")), "id", "left").where((F.col("colour") == F.col("back")) | (F.col("colour") == F.col("id"))).select("id", "colour")
        core = cut(core)
        # a root alone in its colour is on no cycle
        real = core.join(core.groupBy("colour").count().where("count > 1").select("colour"), "colour", "left_semi").select("id")
        found = cut(found.union(real))
        gone = core.select(F.col("id").alias("_g"))
        step = cut(step.join(gone, F.col("a") == F.col("_g"), "left_anti").join(gone, F.col("b") == F.col("_g"), "left_anti"))


def _coloured(step: DataFrame, a: str, b: str) -> DataFrame:
    """id, colour: the smallest id that reaches it along the links, itself included."""
    now = cut(step.select(F.col("a").alias("id")).union(step.select("b")).distinct().withColumn("colour", F.col("id")))
    while True:
        sent = step.join(now, F.col(a) == F.col("id")).groupBy(F.col(b).alias("_to")).agg(F.min("colour").alias("_sent"))
        after = cut(now.join(sent, F.col("id") == F.col("_to"), "left").select("id", F.least("colour", F.coalesce("_sent", "colour")).alias("colour"), (F.col("_sent") < F.col("colour")).alias("_moved")))
        now = after.select("id", "colour")
        if after.where("_moved").isEmpty():
            return now


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(source, id) within so many hops, direction ignored."""
    return reach(edges, seeds, "both", depth).select("source", "id")


def subgraph(edges: DataFrame, center: DataFrame, depth: int = 2) -> DataFrame:
    """Edges with both ends within so many hops of the center, which needn't exist as a node."""
    inside = cut(neighbors(edges, center, depth).select("id").union(center.select("id")).distinct())
    ends = inside.select(F.col("id").alias("_id"))
    found = edges.join(ends, F.col("from_id") == F.col("_id"), "left_semi")
    return found.join(ends, F.col("to_id") == F.col("_id"), "left_semi")


def simple_paths(edges: DataFrame, start: str, end: str, cutoff: int = 6, parallel: bool = False) -> DataFrame:
    """`path`: arrays of ids from start to end without a repeated node, of at most cutoff edges. start = end gives none.

    Only nodes that end is reachable from within the hops left are followed. parallel keeps one path for each parallel edge.
    """
    step = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a <> b")
    step = cut(step if parallel else step.distinct())
    spark = edges.sparkSession
    goal = spark.createDataFrame([(end,)], "id string").select(F.col("id").cast(edges.schema["to_id"].dataType))
    left = cut(reach(edges, goal, "dependents", cutoff).select(F.col("id").alias("_to"), "hops").unionByName(goal.select(F.col("id").alias("_to"), F.lit(0).alias("hops"))))
    now = spark.createDataFrame([([start],)] if start != end else [], "path array<string>").select(F.col("path").cast(f"array<{edges.schema['to_id'].dataType.simpleString()}>"))
    found = now.limit(0)
    for hop in range(1, cutoff + 1):
        grown = now.join(step, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
        grown = grown.join(left, (F.col("b") == F.col("_to")) & (F.col("hops") <= cutoff - hop), "left_semi")
        now = cut(grown.select(F.concat("path", F.array("b")).alias("path")))
        done = F.element_at("path", -1) == F.lit(end)
        found = found.unionByName(now.where(done))
        now = now.where(~done)
    return found


def node_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, ghosts among them, and edges, each counted once by id."""
    ids = nodes.select("id").union(edges.select("from_id")).union(edges.select("to_id")).distinct()
    return ids.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count_distinct("id").alias("edges")))


def unreferenced(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes that no edge, of one kind if given, points at."""
    used = edges.where(F.col("kind") == kind) if kind else edges
    return nodes.join(used.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti")


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node_KIND or edge_KIND), n."""
    n = nodes.groupBy(F.concat(F.lit("node_"), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edge_"), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def add(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key, the new ones winning."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and without every edge that touches them."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    left = nodes.join(gone, F.col("id") == F.col("_id"), "left_anti")
    kept = edges.join(gone, F.col("from_id") == F.col("_id"), "left_anti").join(gone, F.col("to_id") == F.col("_id"), "left_anti")
    return left, kept


def remove_edges(edges: DataFrame, condition: Column) -> DataFrame:
    """Without the edges that meet a condition, such as an id or a file_path."""
    return edges.where(~F.coalesce(condition, F.lit(False)))


def with_ghosts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, name, path, file_id, line_start of every node; ghosts have kind unknown."""
    for name, kind in (("name", "string"), ("path", "string"), ("file_id", "string"), ("line_start", "int")):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    known = nodes.select("id", "kind", "name", "path", "file_id", "line_start")
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    ghosts = ends.join(known.select("id"), "id", "left_anti")
    blank = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("name", "path", "file_id", "line_start")]
    return known.unionByName(ghosts.select("id", F.lit("unknown").alias("kind"), *blank))


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each node and edge: part (nodes or edges) and json. Kinds are plain values."""
    full = with_ghosts(nodes, edges)
    n = full.select(F.lit("nodes").alias("part"), F.to_json(F.struct("id", "kind", F.coalesce("name", basename(F.col("path"))).alias("name"), "path", "file_id", "line_start")).alias("json"))
    e = edges.select(F.lit("edges").alias("part"), F.to_json(F.struct(F.col("from_id").alias("source"), F.col("to_id").alias("target"), "kind", "id", "line_number", "weight")).alias("json"))
    return n.unionByName(e)


def dot_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The body lines of a dot digraph. Labels are names, or basenames of files, or the first 8 characters of a ghost's id."""
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    full = with_ghosts(nodes, edges)
    label = F.coalesce(F.col("name"), basename(F.col("path")), F.substring("id", 1, 8))
    n = full.select(F.format_string('  "%s" [label="%s" tooltip="%s"];', F.col("id"), quoted(label), F.col("kind")).alias("line"))
    return n.unionByName(edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', F.col("from_id"), F.col("to_id"), F.col("kind")).alias("line")))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of parts: the head, the lines, the tail."""
    spark = nodes.sparkSession
    spark.createDataFrame([("digraph lodegraph {\n  rankdir=LR;\n  node [shape=box];",)], "line string").coalesce(1).write.mode("overwrite").text(path)
    dot_rows(nodes, edges).write.mode("append").text(path)
    spark.createDataFrame([("}",)], "line string").coalesce(1).write.mode("append").text(path)


def top_per(table: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key."""
    return table.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
