"""The driver's tables as graphs, files and journals: nodes and edges of the star schema, event transitions, documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, file_id: regions, nations, customers, suppliers, parts and orders. An order's file is its customer's, and so on up."""
    def of(table: str, kind: str, key: str, name: str, parent: str) -> DataFrame:
        t = read(spark, sf_dir, table)
        return t.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.concat(F.lit("file:"), F.expr(parent).cast("string")).alias("file_id"))

    parts = [
        of("region", "region", "r_regionkey", "r_name", "'root'"), of("nation", "nation", "n_nationkey", "n_name", "n_nationkey"), of("customer", "customer", "c_custkey", "c_name", "c_nationkey"),
        of("supplier", "supplier", "s_suppkey", "s_name", "s_nationkey"), of("part", "part", "p_partkey", "p_name", "p_brand"), of("orders", "order", "o_orderkey", "o_orderstatus", "o_orderstatus"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id-less edges (kind, from_id, to_id, line_number), the dependent first."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def of(table: str, kind: str, a, b, line=None) -> DataFrame:
        return read(spark, sf_dir, table).select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), (line if line is not None else F.lit(None)).cast("int").alias("line_number"))

    parts = [
        of("nation", "uses", node("nation", "n_nationkey"), node("region", "n_regionkey")), of("customer", "uses", node("customer", "c_custkey"), node("nation", "c_nationkey")),
        of("supplier", "uses", node("supplier", "s_suppkey"), node("nation", "s_nationkey")), of("orders", "calls", node("order", "o_orderkey"), node("customer", "o_custkey")),
    ]
    parts += [of("lineitem", "calls", node("order", "l_orderkey"), node("part", "l_partkey"), F.col("l_linenumber")), of("lineitem", "calls", node("order", "l_orderkey"), node("supplier", "l_suppkey"), F.col("l_linenumber"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STAR_NODES_SQL = """star_nodes AS (
    SELECT 'region:' || r_regionkey AS id, 'region' AS kind, CAST(r_name AS VARCHAR) AS name, 'file:root' AS file_id FROM region UNION ALL
    SELECT 'nation:' || n_nationkey, 'nation', n_name, 'file:' || n_nationkey FROM nation UNION ALL
    SELECT 'customer:' || c_custkey, 'customer', c_name, 'file:' || c_nationkey FROM customer UNION ALL
    SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'file:' || s_nationkey FROM supplier UNION ALL
    SELECT 'part:' || p_partkey, 'part', p_name, 'file:' || p_brand FROM part UNION ALL
    SELECT 'order:' || o_orderkey, 'order', o_orderstatus, 'file:' || o_orderstatus FROM orders)"""
STAR_EDGES_SQL = """star_edges AS (
    SELECT 'uses' AS kind, 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, CAST(NULL AS INTEGER) AS line_number FROM nation UNION ALL
    SELECT 'uses', 'customer:' || c_custkey, 'nation:' || c_nationkey, NULL FROM customer UNION ALL
    SELECT 'uses', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, NULL FROM supplier UNION ALL
    SELECT 'calls', 'order:' || o_orderkey, 'customer:' || o_custkey, NULL FROM orders UNION ALL
    SELECT 'calls', 'order:' || l_orderkey, 'part:' || l_partkey, l_linenumber FROM lineitem UNION ALL
    SELECT 'calls', 'order:' || l_orderkey, 'supplier:' || l_suppkey, l_linenumber FROM lineitem)"""


def star_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The star nodes as symbols with their files: nations are types and regions variables; the ordinal is the number in the id."""
    nodes = star_nodes(spark, sf_dir)
    kind = F.when(F.col("kind") == "nation", "type").when(F.col("kind") == "region", "variable").otherwise("function")
    symbols = nodes.select("id", "file_id", "name", kind.alias("kind"), F.split("id", ":")[1].cast("int").alias("ordinal"))
    files = nodes.select(F.col("file_id").alias("id"), F.concat(F.lit("src/"), F.substring("file_id", 6, 1000)).alias("path")).distinct()
    return files, symbols


STAR_SYMBOLS_SQL = """star_symbols AS (SELECT id, file_id, name, CASE kind WHEN 'nation' THEN 'type' WHEN 'region' THEN 'variable' ELSE 'function' END AS kind,
    CAST(split_part(id, ':', 2) AS INTEGER) AS ordinal, 'src/' || substr(file_id, 6) AS path FROM star_nodes)"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct transitions between a user's consecutive event types: a small graph with cycles."""
    e = read(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.lit("calls").alias("kind"), F.col("event_type").alias("from_id"), nxt.alias("to_id"), F.lit(None).cast("int").alias("line_number")).where("to_id IS NOT NULL").distinct()


EVENT_EDGES_SQL = """event_edges AS (SELECT DISTINCT from_id, to_id FROM (
    SELECT event_type AS from_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id FROM events) WHERE to_id IS NOT NULL)"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content, language."""
    return read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), "doc_id")
