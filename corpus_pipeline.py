"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept, as a table; all but the last return documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import divergence, jaccard_join, packing, suffixes, toxicity
from varve.llm.common import ensure_checkpoints

TOKENIZER = "byte_bpe_50k.json"


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that repeat another share its verdict."""
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))
    verdicts = divergence.quality(docs.select(key.alias("doc_id"), "text", "lang"))
    name = unused(docs, "verdict_key")
    kept = verdicts.where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(kept, name, "left_semi").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier lets pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, then the smallest text hash.
    A row that repeats another's id and text goes."""
    found = jaccard_join.similar(docs).groupBy("component_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    )
    name, stay_id, stay_key = (unused(docs, c) for c in ("text_key", "stay_id", "stay_key"))
    stays = found.select(F.col("first.doc_id").alias(stay_id), F.col("first.text_key").alias(stay_key))
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.col(name) == F.col(stay_key))
    return keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", name]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a smaller id has in 50 in a row."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    left = suffixes.dedup(docs, carry=others).select("doc_id", F.col("kept").alias("text"), "carried.*")
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), keep_ids=False)


STAGES = [
    ("quality", quality), ("toxicity", clean), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", pack),
]

#: Learnt scores and bin packing are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the checkpoint folder and read again."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
