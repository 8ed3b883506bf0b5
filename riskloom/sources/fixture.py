"""A synthetic panel with known values: business days and modular returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First and last day, and for each instrument (factor, modulus, shift, divisor).
FIRST_PRICE, LAST = "2007-01-01", "2025-12-31"
SHAPES = {"SPY": (1, 17, 8, 1000.0), "IEF": (3, 19, 9, 2000.0), "GLD": (5, 23, 11, 1500.0)}
PROXY, WEIGHTS = "FIXTURE_PROXY", {"SPY": 0.60, "IEF": 0.30, "GLD": 0.10}


def shaped(rows: DataFrame, position: str) -> DataFrame:
    """The rows with a column of returns per instrument, from their position on the calendar."""
    return rows.withColumns({k: (F.pmod(F.col(position) * f, F.lit(m)) - s) / d for k, (f, m, s, d) in SHAPES.items()})


def calendar(spark: SparkSession) -> DataFrame:
    """(date, p): the business days with a return and their positions from 0; the first business
    day has a price but no return."""
    days = spark.sql(f"SELECT explode(sequence(date'{FIRST_PRICE}', date'{LAST}')) AS date").where("weekday(date) < 5")
    return days.withColumn("p", F.row_number().over(Window.orderBy("date")) - 2).where("p >= 0")  # a few thousand days


def returns(spark: SparkSession) -> DataFrame:
    """date and a column per instrument."""
    return shaped(calendar(spark), "p").select("date", *SHAPES)


def returns_at(keys: DataFrame, key: str) -> DataFrame:
    """(key, date, a column per instrument): the whole calendar and all keys as positions on it.
    Keys past its end run through it again: the date is that of the key by the calendar's
    length, the returns go on. Days that no key under the length holds come with a null key."""
    days = calendar(keys.sparkSession)
    n = days.count()
    placed = keys.withColumn("p", F.pmod(key, F.lit(n)).cast("int")).join(F.broadcast(days), "p", "left")
    held = keys.where((F.col(key) >= 0) & (F.col(key) < n)).select(F.col(key).cast("int").alias("p"))
    free = days.join(held, "p", "left_anti").select(F.lit(None).cast("bigint").alias(key), "date", "p")
    rows = placed.select(key, "date", F.col(key).alias("p")).unionByName(free.withColumn("p", F.col("p").cast("bigint")))
    return shaped(rows, "p").select(key, "date", *SHAPES)
