"""Recursions v -> factor * v + input as a scan of affine maps, so that one series can be spread
over many tasks.

1. Positions from `first` on are cut into blocks. What a block adds to the state behind it is
   one sum, which Spark combines before anything is shuffled; its factor is factor**length.
2. The states before the blocks follow from a row a block, in order: one small task a series.
3. Each block is replayed from its own state by a running sum within the block.

Within a block inputs are weighed by factor**-place; blocks are short enough that this stays
far inside the range of a double.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import importable

#: Positions of a block at most, and the largest logarithm of a weight in it.
BLOCK, LARGEST_LOG = 4096, 460.0


def block_length(factor: float) -> int:
    if factor <= 0:
        return 1
    return max(1, min(BLOCK, int(LARGEST_LOG / max(1e-12, abs(math.log(factor))))))


def affine_scan(panel: DataFrame, name: str, factor: float, added: Column, start: Column, first: int, dealt: bool = False) -> DataFrame:
    """The panel (series_id, pos from 0 without gaps, ...) with the column `name`: null before
    position first - 1, there the aggregate `start` of the positions up to it, then
    factor * (the state before) + added. A series of fewer than `first` rows has nulls. dealt:
    the panel is dealt by series already and stays so; the states before the blocks are then
    folded to a row a series, where else blocks are spread over tasks."""
    importable(panel.sparkSession)
    length = block_length(factor)
    place = F.col("pos") - first
    rows = panel.withColumns({"_block": F.when(place >= 0, F.floor(place / length)).otherwise(F.lit(-1)).cast("bigint"), "_place": F.when(place >= 0, place % length).cast("double"), "_added": added})
    sums = rows.groupBy("series_id", "_block").agg(F.sum(F.when(F.col("_block") >= 0, F.col("_added") * F.pow(F.lit(factor), length - 1 - F.col("_place")))).alias("sum"), F.when(F.col("_block") < 0, start).alias("start"), F.count(F.lit(1)).alias("n"))

    def heads(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        short = blocks["_block"].iloc[0] >= 0 or blocks["n"].iloc[0] < first
        v, out, whole = math.nan if short else float(blocks["start"].iloc[0]), [], factor**length
        for block, total in zip(blocks["_block"], blocks["sum"], strict=True):
            out.append(v)
            if block >= 0:
                v = whole * v + total
        return pd.DataFrame({"series_id": blocks["series_id"], "_block": blocks["_block"], "_head": out})

    if dealt:
        short = F.coalesce(F.max(F.when(F.col("_block") < 0, F.col("n"))), F.lit(0).cast("bigint")) < first
        begun, whole = F.when(short, F.lit(math.nan)).otherwise(F.max("start")), F.lit(factor**length)
        told = sums.groupBy("series_id").agg(begun.alias("_start"), F.sort_array(F.collect_list(F.when(F.col("_block") >= 0, F.struct("_block", "sum")))).alias("_sums"))
        folded = F.aggregate("_sums", F.array("_start"), lambda done, x: F.concat(done, F.array(whole * F.element_at(done, -1) + x["sum"])))
        met = rows.join(told.select("series_id", folded.alias("_heads")), "series_id", "left").withColumn("_head", F.get("_heads", F.greatest("_block", F.lit(0)).cast("int")))
    else:
        known = sums.groupBy("series_id").applyInPandas(heads, "series_id string, _block bigint, _head double")
        met = rows.join(known, ["series_id", "_block"], "left")
    inside = Window.partitionBy("series_id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d, place = F.lit(factor), F.col("_place")
    replayed = F.pow(d, place + 1) * F.col("_head") + F.pow(d, place) * F.sum(F.col("_added") * F.pow(d, -place)).over(inside)
    state = F.when(F.col("_block") >= 0, replayed).when(F.col("pos") == first - 1, F.col("_head"))
    return met.withColumn(name, state).select(*panel.columns, name)
