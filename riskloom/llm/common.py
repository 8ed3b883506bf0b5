"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import importable

#: The white space of every text contract here: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts go to Python workers in Arrow batches of about so many bytes, unless the session says otherwise.
ARROW_BYTES = 8 << 20
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def workers_ready(spark: SparkSession) -> SparkSession:
    """Python workers find this package and get small Arrow batches: an executor holds
    a batch once outside its heap (in a buffer of up to twice its size) and once in the worker
    for each of its cores. A size that the session names is left as it is."""
    if spark.conf.get(_ARROW_KEY, None) is None:
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))
    return importable(spark)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def salt_of(buckets: int, *cols) -> Column:
    """A salt from 0 to buckets - 1 that is the same whenever a task is run again."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


#: Keys that hold more than one in so many of all rows are hot; there are at most as many of them.
HOT_KEYS = 4096
HOT_LEAST = 256
HOT_SALTS = 64


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, spread_by: list[str]) -> DataFrame:
    """rows left-joined with table (one row a key; `weight` is the number of rows that look it
    up). Hot keys are salted on both sides, so none lands in one task; rows with a null key
    are spread too and find nothing. Only the names of the hot keys are broadcast, HOT_KEYS
    rows at most. The weight is dropped."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) > max(HOT_LEAST, total // HOT_KEYS)).select(key, F.lit(True).alias("_hot")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt_of(HOT_SALTS, *spread_by)).when(F.col(key).isNull(), salt_of(1 << 20, *spread_by)).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.drop(weight).join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local
    mode (tests) a temporary folder where that is unset. A cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        set_by_us = spark.conf.get("riskloom.shared.dir", None)
        if set_by_us:
            return set_by_us
        top = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("riskloom.shared.dir", top)
    return top


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its scratch folder goes with it
        pass


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which goes when the driver's Python ends."""
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again. This cuts the lineage,
    so a lost executor costs its tasks only and no earlier step is run twice."""
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
