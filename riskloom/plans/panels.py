"""Panels derived from the star-schema tables: three series from line items.

series = return flag, level = mean extended price of a ship date, on dates that all three have.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.config import Config, Evaluation, Ewma, Experiment, Garch, Historical, Periods, Proxy, Upstream
from riskloom.operators import panel

NAMES = ("A", "N", "R")
PROXY = "PROXY"
WEIGHTS = {"A": 0.60, "N": 0.30, "R": 0.10}
PROFILE = Config(
    Experiment("lineitem-profile", "in", "out", 42),
    Upstream("riskloom-tables", "1", "riskloom/simple-returns", "1", "decimal_return_per_observation", NAMES),
    Periods(date(1995, 1, 1), date(1997, 12, 31), date(1998, 1, 1), date(1998, 12, 31), date(1999, 1, 1), date(2001, 12, 31)),
    Proxy(PROXY, tuple(WEIGHTS.items())),
    Historical(60, 100),
    Ewma(0.94, 60),
    Garch(100, 20),
    Evaluation(20, 500, 0.95),
)


def instrument_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    levels = rows.groupBy("series_id", "date").agg((F.sum("price").cast("double") / F.count(F.lit(1))).alias("level"))
    return panel.aligned_returns(levels, list(NAMES))


def wide_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.to_wide(instrument_returns(spark, sf_dir), list(NAMES))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of the three series and their weighted proxy. It has a row a series and day,
    feeds every model, and is kept, so the line items are scanned once."""
    place = (F.array_position(F.array(*map(F.lit, NAMES)), F.col("series_id")) - 1).cast("int")
    long = panel.with_positions(instrument_returns(spark, sf_dir).withColumn("series_pos", place))
    return panel.with_long_proxy(long, WEIGHTS, PROXY).cache()


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel that grows with the tables: a series a supplier, level = logarithm of the mean
    extended price of a week, on the weeks that the supplier has."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("int").alias("series_pos"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    levels = rows.groupBy("series_pos", "date").agg(F.ln(F.sum("price").cast("double") / F.count(F.lit(1))).alias("level"))
    levels = levels.withColumn("series_id", F.concat(F.lit("S"), F.col("series_pos").cast("string")))
    before = F.lag("level").over(Window.partitionBy("series_id").orderBy("date"))  # dealt once, by series
    returns = levels.withColumn("simple_return", F.col("level") / before - 1).where("simple_return IS NOT NULL")
    return panel.with_positions(returns.select("series_id", "series_pos", "date", "simple_return")).cache()
