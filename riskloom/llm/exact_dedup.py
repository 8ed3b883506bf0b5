"""Exact duplicates by skew-safe combining, in DataFrame operations only.

The rows of one text meet in three stages, each of which compares whole texts:

1. every map task combines its own copies (the partial aggregate);
2. copies meet in salted groups keyed by digest, salt and text, so that a text held by a
   third of all rows is spread over `salts` keys, each of which gets at most one row a map task;
3. the winners of the salts (at most `salts` rows for a digest) meet in one window, where the
   smallest and largest text must be the same.

The rows then learn their group through a join on digest and salt, which carries no text. Rows
without an id have a salt of their own there, each dealt to one of SPREAD copies of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE_CLASS, documents, salt_of, text_of

SALTS = 16
#: Copies of the group that rows without an id look up.
SPREAD = 64


def normalised(text: str = "text") -> Column:
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text_of(text), SPACE_CLASS, " ")


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the smallest id is kept. Nulls
    are passed over when the smallest id is sought; a row with a null id is kept only if its
    group has no other id. Rows that repeat the smallest id of their group with the same text
    are all marked as kept and all count in group_size. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256))).withColumn("salt", F.when(F.col("id").isNull(), -1).otherwise(salt_of(salts, "id")))
    winners = rows.groupBy("digest", "salt", "body").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("digest")
    same = F.min("body").over(group) == F.max("body").over(group)
    found = winners.select(
        "digest",
        "salt",
        F.min("id").over(group).alias("keep_id"),
        F.when(same, F.sum("n").over(group)).otherwise(F.raise_error(F.lit("different texts have one digest")).cast("long")).alias("group_size"),
    )
    # Any copy will do for a row without an id, so its number need not be the same in every attempt.
    dealt = F.when(F.col("salt") < 0, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")).otherwise(F.col("salt"))
    copies = F.explode(F.when(F.col("salt") < 0, F.sequence(F.lit(-SPREAD), F.lit(-1))).otherwise(F.array("salt")))
    rows = rows.select("id", "digest", dealt.alias("salt"))
    return rows.join(found.withColumn("salt", copies), ["digest", "salt"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of df that duplicate_groups keeps, with their columns as they are. Rows that
    repeat an id with the same text are reduced to one of them."""
    kept = duplicate_groups(df, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))
    one = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["digest"] == kept["kept_digest"]), "left_semi")
    return one.dropDuplicates(["id", "digest"]).select("row.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
