"""The next key in ascending order, without sorting a whole table in one task.

Keys are grouped by their high bits; within a group a window finds the next key, and the last
key of a group takes the first key of the next group that exists, found the same way one
level up. The one window without partitions gets TOP keys at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import written

TOP = 4096
BITS = 8


def next_keys(keys: DataFrame) -> DataFrame:
    """keys(key): distinct longs. Returns (key, next); the largest key has a null next."""
    keys = written(keys.select("key"), "keys")
    if keys.count() <= TOP:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    inside = Window.partitionBy("high").orderBy("key")
    within = keys.withColumn("high", F.shiftright("key", BITS)).withColumn("near", F.lead("key").over(inside))
    firsts = within.groupBy("high").agg(F.min("key").alias("first"))
    upper = next_keys(firsts.select(F.col("high").alias("key"))).select(F.col("key").alias("high"), F.col("next").alias("after"))
    start = firsts.select(F.col("high").alias("after"), "first")
    return within.join(upper.join(start, "after", "left").select("high", "first"), "high", "left").select("key", F.coalesce("near", "first").alias("next"))
