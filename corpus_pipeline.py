"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. docs is what the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common, exact_dedup, jaccard_join, mixing, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under its threshold go."""
    model, _ = quality.trained(docs, quality.labels_of(spark, sf_dir))
    score = common.free_name(docs, "score")
    return quality.with_score(docs, model, score, least=quality.THRESHOLD).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by 5-word shingle Jaccard of 0.8 or more, one row
    stays: the one with the smallest id, of several such the one whose text has the smallest
    hash; a null id comes last. Rows that are equal in both stay together."""
    rows = common.written(jaccard_join.jaccard_components(docs, k=5, percent=80, detail=True).where("component IS NOT NULL"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_print").alias("print"))
    groups = rows.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    found = common.salted_lookup(rows, common.written(groups, "groups"), "component", "size", ["doc_id", "text_print"])
    gone = found.where(F.col("first").isNotNull() & (order != F.col("first"))).select(F.col("doc_id").alias("gone_id"), F.col("text_print").alias("gone_print")).distinct()
    gone = common.written(gone, "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_print"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in proportion to the target weights, repeated as often as epochs take them."""
    return mixing.epochs_of(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power-of-two length with digests of their ids."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: The classifier and the tokenizer can't be expressed in SQL; tests/llm holds run() against a
#: brute-force version.
ORACLE_SQL = None
