"""Removal of lines that many documents share, in DataFrame operations only.

Lines are exploded as 16-byte hashes of their keys (no text is moved for the count), counted
by hash and salt with map-side combining, and summed per hash. The lines that meet the
threshold give each document a list of positions to drop; the document is split again, those
positions go, and the rest are joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import SPACES, ascii_lower, documents, salt_of, text_of

MIN_DOCUMENTS = 10
MIN_CHARS = 1
SALTS = 16


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """For each line of the text the hash of its key, null for keys under min_chars."""
    strip = F.lit(SPACES)
    key = lambda line: F.btrim(line, strip)
    hashed = lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k.cast("binary"))))
    return F.transform(F.transform(F.split(ascii_lower(text), "\n", -1), key), hashed)


def drop_common_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """One row per input row: id_col, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line, which has no key and stays. A row is a document;
    rows that repeat an id count as documents of their own, and equal rows get equal results.
    Null ids are allowed. If every line goes, kept_text is empty. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    lines = rows.select("id", "print", F.posexplode(line_keys(F.col("text"), min_chars)).alias("at", "key")).where("key IS NOT NULL")
    lines = lines.withColumn("salt", salt_of(salts, "id", "print"))
    first = rows.select("id", "print", F.explode(F.array_distinct(line_keys(F.col("text"), min_chars))).alias("key")).where("key IS NOT NULL")
    counts = first.withColumn("salt", salt_of(salts, "id", "print")).groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"))
    common = counts.select("key", "salt", F.sum("n").over(Window.partitionBy("key")).alias("n")).where(F.col("n") >= min_documents).drop("n")
    drops = lines.join(common, ["key", "salt"]).groupBy("id", "print").agg(F.collect_set("at").alias("drops")).select(F.col("id").alias("_id"), F.col("print").alias("_print"), "drops")
    split = rows.select("id", "print", F.split("text", "\n", -1).alias("lines"))
    joined = split.join(drops, split["id"].eqNullSafe(drops["_id"]) & (split["print"] == drops["_print"]), "left")
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    left = F.transform(at, lambda i: F.element_at(F.col("lines"), i + 1))
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(left), "\n").alias("kept_text"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_common_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
