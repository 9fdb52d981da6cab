"""A corpus from documents to packed sequences, in five stages. Each stage's rows are written and read again for the next.

toxicity: documents that score 0.5 or more go. line_dedup: lines on three sites and more (ten if they have under five words; lines of fifty words
and more in two distinct texts) stay in their first document; documents that keep no text go. near_dup: one document of each group that shares word 5-shingles at a
similarity of 0.8 or more stays. mixing: documents are left out or repeated so that sources come near their targets.
packing: pieces of at most 4096 tokens, with their ids, in as few sequences as can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import jaccard, linededup, mixing, packing
from lodegraph.llm import toxicity as tox
from lodegraph.llm.common import free_shuffles, prepare, stored
from lodegraph.llm.tokens import default_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = tox.fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tox.keep_clean(docs, model, COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.remove_shared_lines(docs, extra=("lang", "source"))
    kept = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_shuffles(prepare(spark))
    return jaccard.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_shuffles(prepare(spark))
    mixed = mixing.mix(docs, extra=("text", "lang", "n_chars"))
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, default_vocabulary(), keep_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dup", near_dup), ("mixing", mix), ("packing", pack)]
#: SQL can't express the trained classifier, the sampling or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
