"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, linededup, mixing, ogg, packing, pii, records, rotated, toxicity
from .common import crc_bucket, prepare
from .tokens import default_vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, shards = records.write_records(table(spark, sf_dir, "documents"), default_vocabulary())
    return records.read_records(spark, at, shards)


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.to_media(table(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_shared_lines(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), keep_ids=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_table(docs, labels)
    return toxicity.score_documents(docs, model).withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id")) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted", "n_toxic", "spans")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], rows.schema)
    return chat.digests(chat.expand(rows.unionByName(extra)))


QUERIES = {f.__name__: f for f in (op1_pii, op2_records, op3_ogg, op4_lines, op5_vectors, op6_packing, op7_toxicity, op8_jaccard, op9_mixing, op10_chat)}

ORACLE_SQL = {
    "op4_lines": f"""
        WITH numbered AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
        lines AS (SELECT r, doc_id, source, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered),
        keyed AS (SELECT *, regexp_replace(line, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g') AS k,
            len(regexp_extract_all(line, '[^ \\x09-\\x0D]+')) AS words FROM lines),
        shared AS (SELECT k, min(doc_id) AS first, arg_min(whole, doc_id) AS first_whole FROM keyed WHERE k <> '' GROUP BY k, words
            HAVING CASE WHEN words >= {linededup.LONG_WORDS} THEN count(DISTINCT whole) >= {linededup.LONG_SITES}
                WHEN words >= {linededup.MIN_WORDS} THEN count(DISTINCT source) >= {linededup.MIN_SITES} ELSE count(DISTINCT source) >= {linededup.SHORT_SITES} END),
        marked AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.first AND NOT (words >= {linededup.LONG_WORDS} AND whole = first_whole) AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
        SELECT any_value(doc_id) AS doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
            count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
        FROM marked GROUP BY r""",
    "op5_vectors": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
            AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
        walk AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT walk.u, links.v FROM walk JOIN links ON walk.v = links.u),
        comp AS (SELECT u, min(v) AS component_id FROM walk GROUP BY u),
        n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT comp.u AS vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.u = component_id AS kept FROM comp LEFT JOIN n ON comp.u = n.u""",
    "op8_jaccard": """
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(x) AS x FROM s, unnest(s) AS t(x)),
        p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
        links AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * c >= 85 * (m + n - c)),
        walk AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT walk.u, links.v FROM walk JOIN links ON walk.v = links.u),
        comp AS (SELECT u, min(v) AS component_id FROM walk GROUP BY u)
        SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN comp ON s.doc_id = comp.u""",
}

