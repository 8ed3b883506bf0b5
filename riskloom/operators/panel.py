"""The return panel: one row per series and date.

Columns: series_id, series_pos (the order of series), date, pos (position within the series
from 0), simple_return.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.errors import fail

PANEL = ("series_id", "series_pos", "date", "pos", "simple_return")


def with_positions(long: DataFrame) -> DataFrame:
    """Adds pos to (series_id, series_pos, date, simple_return)."""
    order = Window.partitionBy("series_id").orderBy("date")
    return long.withColumn("pos", F.row_number().over(order) - 1).select(*PANEL)


def with_proxy(wide: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """wide (date and a column per instrument) with the weighted sum as a further column; the
    sum runs from 0 in the order of the columns."""
    names = [c for c in wide.columns if c != "date"]
    check_weights(names, weights, name)
    return wide.withColumn(name, reduce(lambda total, c: total + F.col(c) * F.lit(weights[c]), names, F.lit(0.0)))


def check_weights(names: list[str], weights: dict[str, float], name: str) -> None:
    if names != list(weights):
        raise fail("CONFIG_INVALID", "The weights must name the panel's instruments in their order.")
    if abs(sum(weights.values()) - 1) > 1e-12:
        raise fail("CONFIG_INVALID", "The weights must sum to one.")
    if name in names:
        raise fail("CONFIG_INVALID", "The proxy's name is the name of an instrument.")


def with_long_proxy(panel: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """A panel with the weighted sum of its series as a further series, the last one. No column
    stands for a series, so there may be thousands: the returns of a date are put in the order
    of the weights and summed from 0. A date that lacks a series has no sum. Weights are a
    table of the configuration, a row an instrument."""
    check_weights(list(weights), weights, name)
    spark = panel.sparkSession
    table = spark.createDataFrame([(k, i, float(w)) for i, (k, w) in enumerate(weights.items())], "series_id string, _place int, _weight double")
    weighed = panel.join(F.broadcast(table), "series_id").groupBy("date").agg(F.sort_array(F.collect_list(F.struct("_place", "_weight", "simple_return"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["simple_return"] * p["_weight"])
    proxy = weighed.where(F.size("parts") == len(weights)).select(F.lit(name).alias("series_id"), F.lit(len(weights)).alias("series_pos"), "date", total.alias("simple_return"))
    return panel.select(*PANEL).unionByName(with_positions(proxy))


def to_long(wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A panel from a wide table; the order of columns gives series_pos."""
    names = names or [c for c in wide.columns if c != "date"]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("series_id"), F.lit(i).alias("series_pos"), F.col(c).cast("double").alias("simple_return")) for i, c in enumerate(names)]))
    return with_positions(wide.select("date", rows.alias("x")).select("x.series_id", "x.series_pos", "date", "x.simple_return"))


def to_wide(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.groupBy("date").pivot("series_id", names).agg(F.first("simple_return")).select("date", *names)


def aligned_returns(levels: DataFrame, names: list[str]) -> DataFrame:
    """Simple returns of (series_id, date, level) on the dates that all named series have:
    (series_id, date, simple_return). The first common date has no return."""
    wanted = levels.where(F.col("series_id").isin(names))
    common = wanted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("n") == len(names))
    before = F.lag("level").over(Window.partitionBy("series_id").orderBy("date"))
    return common.select("series_id", "date", (F.col("level") / before - 1).alias("simple_return")).where("simple_return IS NOT NULL")


#: Rows of one input split are numbered by Spark from the split's number times 2**SPLIT_BITS.
SPLIT_BITS = 33


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows just read from files with their position in file order, from 0. Each split counts
    its own rows; a table of a row a split gives the positions before it, so no task sees more
    than one split."""
    own = rows.withColumn("_own", F.monotonically_increasing_id())
    split = F.shiftright("_own", SPLIT_BITS)
    counts = own.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_split", (F.sum("n").over(Window.orderBy("_split")) - F.col("n")).alias("_before"))
    placed = own.withColumn("_split", split).join(F.broadcast(before), "_split")
    return placed.withColumn(name, F.col("_before") + F.col("_own").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))).drop("_own", "_split", "_before")


#: Positions whose dates one task compares.
INDEX_BITS = 12


def index_faults(dates: DataFrame) -> DataFrame:
    """Faults of an index (pos, date) in file order: rows (fault, date), none if it is sound.
    Neighbours are compared within ranges of positions; only each range's last date meets the
    next range, in a window of one row a range."""
    ranges = dates.withColumn("range", F.shiftright(F.col("pos").cast("bigint"), INDEX_BITS))
    ends = ranges.groupBy("range").agg(F.max_by("date", "pos").alias("end"))
    ends = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("end"))
    before = F.coalesce(F.lag("date").over(Window.partitionBy("range").orderBy("pos")), "end")
    twice = dates.groupBy("date").count().where("count > 1").select(F.lit("duplicate").alias("fault"), "date")
    back = ranges.join(ends, "range").withColumn("before", before).where("date < before").select(F.lit("unsorted").alias("fault"), "date")
    return twice.unionByName(back)


def check_index(dates: DataFrame) -> None:
    """Raises for an empty, repeated or unsorted index."""
    if dates.limit(1).count() == 0:
        raise fail("WINDOW_ALIGNMENT_ERROR", "The panel has no dates.")
    found = {r[0] for r in index_faults(dates).select("fault").distinct().collect()}
    if "duplicate" in found:
        raise fail("INPUT_DATE_DUPLICATE", "The panel repeats a date.")
    if "unsorted" in found:
        raise fail("INPUT_DATE_UNSORTED", "The panel's dates do not increase.")
