"""Forecast windows: which observations a forecast may see, and which date it is for.

A window's origin is the last date it may see; its target is the next date of the series. The
period is the target's, and targets outside all periods have no window. All windows of a
series come from one window-function pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import Periods
from riskloom.errors import fail

# The columns of the windows and realizations tables.
WINDOWS = ("series_id", "model_id", "forecast_origin", "target_date", "train_start", "train_end", "train_observation_count", "period", "scheduled_refit")
REALIZATIONS = ("series_id", "forecast_origin", "target_date", "simple_return", "squared_return", "loss", "period")


def period_of(day: Column, periods: Periods) -> Column:
    """The period that holds a date, both ends included; null in gaps and outside."""
    out = F.lit(None).cast("string")
    for name, start, end in reversed(periods.ranges()):
        out = F.when(day.between(F.lit(start), F.lit(end)), name).otherwise(out)
    return out


def _eligible(panel: DataFrame, window: int, periods: Periods, expanding: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep: further columns of the panel at the origin. Values that models computed by window
    functions stay in the same pass, so forecasts need no join."""
    if window < 2:
        raise fail("INSUFFICIENT_HISTORY", "A window needs two observations at least.")
    series = Window.partitionBy("series_id").orderBy("pos")
    start = F.first("date").over(series) if expanding else F.lag("date", window - 1).over(series)
    rows = panel.select(
        "series_id",
        "series_pos",
        "pos",
        F.col("date").alias("forecast_origin"),
        F.lead("date").over(series).alias("target_date"),
        start.alias("train_start"),
        F.col("date").alias("train_end"),
        (F.col("pos") + 1 if expanding else F.lit(window)).cast("bigint").alias("train_observation_count"),
        *keep,
    )
    rows = rows.withColumn("period", period_of(F.col("target_date"), periods))
    return rows.where((F.col("pos") >= window - 1) & F.col("target_date").isNotNull() & F.col("period").isNotNull())


def trailing_windows(panel: DataFrame, window: int, periods: Periods, model_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The last `window` observations up to the origin."""
    return _eligible(panel, window, periods, False, keep).select("*", F.lit(model_id).alias("model_id"), F.lit(False).alias("scheduled_refit"))


def expanding_windows(panel: DataFrame, least: int, periods: Periods, model_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All observations up to the origin, `least` at least."""
    return _eligible(panel, least, periods, True, keep).select("*", F.lit(model_id).alias("model_id"), F.lit(False).alias("scheduled_refit"))


def refit_windows(panel: DataFrame, window: int, every: int, periods: Periods, model_ids: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Trailing windows with a refit at every `every`-th eligible origin of a series (targets in
    no period are not counted), for each model; fit_block numbers the stretches between."""
    if every < 1:
        raise fail("WINDOW_ALIGNMENT_ERROR", "The refit interval must be positive.")
    at = F.row_number().over(Window.partitionBy("series_id").orderBy("pos")) - 1
    rows = _eligible(panel, window, periods, False, keep).withColumn("at", at)
    rows = rows.withColumn("scheduled_refit", F.col("at") % every == 0).withColumn("fit_block", F.floor(F.col("at") / every).cast("int"))
    return rows.withColumn("model_id", F.explode(F.array(*map(F.lit, model_ids)))).drop("at")


def refit_chunks(panel: DataFrame, window: int, every: int, periods: Periods, fits: int) -> DataFrame:
    """The rows that fits need, by chunk of `fits` fit blocks: (series_id, chunk, pos, date,
    target_date, simple_return, at). `at` numbers the eligible origins as refit_windows does,
    and is -1 for other positions. A position goes once to each chunk of which it is an origin
    or lies in a window; both follow from the number of origins before it and before the
    position a window later, so no window is gathered."""
    series = Window.partitionBy("series_id").orderBy("pos")
    rows = panel.select("series_id", "pos", "date", F.lead("date").over(series).alias("target_date"), "simple_return")
    rows = rows.withColumn("origin", ((F.col("pos") >= window - 1) & period_of(F.col("target_date"), periods).isNotNull()).cast("long"))
    rows = rows.withColumn("before", F.sum("origin").over(series.rowsBetween(Window.unboundedPreceding, 0)) - F.col("origin"))
    all_ = F.sum("origin").over(Window.partitionBy("series_id"))
    rows = rows.withColumn("upto", F.coalesce(F.lead("before", window).over(series), all_))
    own = F.when(F.col("origin") == 1, F.floor(F.col("before") / every))
    low, high = F.ceil(F.col("before") / every), F.floor((F.col("upto") - 1) / every)
    seen = high >= low  # some fit's window holds the position
    rows = rows.withColumn("low", F.least(own, F.when(seen, low))).withColumn("high", F.greatest(own, F.when(seen, high)))
    chunk = F.explode(F.sequence(F.floor(F.col("low") / fits), F.floor(F.col("high") / fits)))
    rows = rows.where("low IS NOT NULL").withColumn("chunk", chunk)
    return rows.select("series_id", "chunk", "pos", "date", "target_date", "simple_return", F.when(F.col("origin") == 1, F.col("before")).otherwise(-1).alias("at"))


def realizations(panel: DataFrame, first_origin: int, periods: Periods) -> DataFrame:
    """What happened on each target date whose origin is at position first_origin or later."""
    series = Window.partitionBy("series_id").orderBy("pos")
    rows = panel.select("series_id", "pos", F.col("date").alias("forecast_origin"), F.lead("date").over(series).alias("target_date"), F.lead("simple_return").over(series).alias("simple_return"))
    rows = rows.withColumn("period", period_of(F.col("target_date"), periods)).where((F.col("pos") >= first_origin) & F.col("period").isNotNull())
    r = F.col("simple_return")
    return rows.withColumn("squared_return", r * r).withColumn("loss", -r).select(*REALIZATIONS)
