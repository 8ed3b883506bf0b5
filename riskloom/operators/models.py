"""Variance and quantile models over a panel.

Each path has a row for every position that has a forecast: (series_id, pos, ...). Historical
variances are window functions, historical quantiles a sorted window in blocks. The recursive models are scans of affine maps (recursions), whose
blocks are the unit of parallelism.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.errors import fail
from riskloom.functions.scoring import loss_quantile
from riskloom.functions.special import Z_01, Z_05
from riskloom.operators.panel import PANEL
from riskloom.operators.recursions import affine_scan
from riskloom.session import importable

# Model names.
HISTORICAL_VARIANCE = "historical_variance"
HISTORICAL_SIMULATION = "historical_simulation"
EWMA = "ewma"
GARCH_GAUSSIAN = "garch_1_1_gaussian"
GARCH_STUDENT_T = "garch_1_1_student_t"
VARIANCE_MODELS = (HISTORICAL_VARIANCE, EWMA, GARCH_GAUSSIAN, GARCH_STUDENT_T)
QUANTILE_MODELS = (HISTORICAL_SIMULATION, EWMA, GARCH_GAUSSIAN, GARCH_STUDENT_T)
CANDIDATES = (EWMA, GARCH_GAUSSIAN, GARCH_STUDENT_T)


def _trailing(window: int):
    if window < 2:
        raise fail("INSUFFICIENT_HISTORY", "A window needs two observations at least.")
    return Window.partitionBy("series_id").orderBy("pos").rowsBetween(1 - window, 0)


def with_variance(panel: DataFrame, window: int) -> DataFrame:
    """The panel with the sample variance (n - 1) of the last `window` returns, null before."""
    v = F.when(F.col("pos") >= window - 1, F.var_samp("simple_return").over(_trailing(window)))
    return panel.withColumn("variance", v).withColumn("volatility", F.sqrt("variance"))


def variance_path(panel: DataFrame, window: int) -> DataFrame:
    return with_variance(panel, window).where(F.col("pos") >= window - 1).select("series_id", "pos", "variance", "volatility")


#: Positions of a block of the sorted window at least; with its overlap a block is a group.
SORTED_BLOCK = 4096
TAILS = {"return_quantile_0_05": 0.05, "return_quantile_0_01": 0.01}


def quantile_places(window: int, method: str, p: float) -> tuple[int, int, float]:
    """Places (low, high) in a sorted window and the weight of high. With h = p * (window - 1):
    linear interpolates, lower and higher take the neighbours, midpoint their mean, nearest the
    closer (even on a tie)."""
    h = p * (window - 1)
    low, high = math.floor(h), math.ceil(h)
    places = {"linear": (low, high, h - low), "lower": (low, low, 0.0), "higher": (high, high, 0.0), "midpoint": (low, high, 0.5), "nearest": (round(h), round(h), 0.0)}
    if method not in places:
        raise fail("CONFIG_INVALID", f"There is no quantile method {method}.")
    return places[method]


def rolling_quantiles(returns: list[float], window: int, places: list[tuple[int, int, float]]) -> list[list[float | None]]:
    """For each place its value over the last `window` returns, null before. The window is kept
    sorted: each step puts one value in and takes one out."""
    held: list[float] = []
    out: list[list[float | None]] = [[] for _ in places]
    for i, x in enumerate(returns):
        insort(held, x)
        if i >= window:
            del held[bisect_left(held, returns[i - window])]
        for column, (low, high, weight) in zip(out, places, strict=True):
            column.append(held[low] + (held[high] - held[low]) * weight if i >= window - 1 else None)
    return out


QUANTILE_COLUMNS = ("return_quantile_0_05", "var_0_95", "return_quantile_0_01", "var_0_99")


def with_simulation(panel: DataFrame, window: int, method: str = "linear") -> DataFrame:
    """The panel with 5 % and 1 % quantiles of the last `window` returns and the losses they
    imply, null before. Series are cut into blocks; the last window - 1 rows of a block go to
    the next one too, so blocks are independent tasks."""
    _trailing(window)
    places = [quantile_places(window, method, p) for p in TAILS.values()]
    size = max(SORTED_BLOCK, 4 * window)
    own = F.floor(F.col("pos") / size)
    rows = panel.withColumn("_block", F.explode(F.when(F.col("pos") % size > size - window, F.array(own, own + 1)).otherwise(F.array(own))))

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        found = rolling_quantiles(rows["simple_return"].to_pylist(), window, places)
        whole = rows.append_column("_first", pa.array(found[0], pa.float64())).append_column("_second", pa.array(found[1], pa.float64()))
        mine = pc.equal(pc.cast(pc.floor(pc.divide(pc.cast(rows["pos"], pa.float64()), float(size))), pa.int64()), rows["_block"])
        return whole.filter(mine).drop_columns(["_block"]).rename_columns([*panel_names, *TAILS])

    panel_names = panel.columns
    importable(panel.sparkSession)
    schema = T.StructType([*panel.schema.fields, *[T.StructField(c, T.DoubleType()) for c in TAILS]])
    return with_losses(rows.groupBy("series_id", "_block").applyInArrow(block, schema))


def simulation_path(panel: DataFrame, window: int, method: str = "linear") -> DataFrame:
    return with_simulation(panel, window, method).where(F.col("pos") >= window - 1).select("series_id", "pos", *QUANTILE_COLUMNS)


def with_losses(path: DataFrame) -> DataFrame:
    return path.withColumn("var_0_95", loss_quantile(F.col("return_quantile_0_05"))).withColumn("var_0_99", loss_quantile(F.col("return_quantile_0_01")))


def with_normal_quantiles(path: DataFrame) -> DataFrame:
    path = path.withColumn("volatility", F.sqrt("variance"))
    return with_losses(path.withColumn("return_quantile_0_05", F.col("volatility") * F.lit(Z_05)).withColumn("return_quantile_0_01", F.col("volatility") * F.lit(Z_01)))


def ewma_step(variance: float, r: float, decay: float) -> float:
    return decay * variance + (1 - decay) * (r * r)


def checked_variance(v: float) -> float:
    if not math.isfinite(v):
        raise fail("NONFINITE_VARIANCE", "A recursive variance is not finite.")
    if v <= 0:
        raise fail("NONPOSITIVE_VARIANCE", "A recursive variance is not positive.")
    return v


def guarded(v: Column) -> Column:
    """The variance; one that is not finite or not positive ends the run."""
    kind = F.when(F.isnan(v) | (F.abs(v) == float("inf")), "NONFINITE_VARIANCE: a recursive variance is not finite").otherwise("NONPOSITIVE_VARIANCE: a recursive variance is not positive")
    return F.when(v.isNull() | (~F.isnan(v) & (v > 0) & (v < float("inf"))), v).otherwise(F.raise_error(kind).cast("double"))


def with_ewma(panel: DataFrame, decay: float, first: int, dealt: bool = False) -> DataFrame:
    """The panel with the exponentially weighted variance and normal quantiles, null before.
    Starts from the sample variance of the first `first` returns, then takes every later
    return of the series. A variance that is not positive ends the run."""
    if not 0 < decay < 1 or first < 2:
        raise fail("CONFIG_INVALID", "The decay must lie between 0 and 1 and the start needs two returns.")
    r = F.col("simple_return")
    rows = affine_scan(panel, "variance", decay, (1 - decay) * (r * r), F.var_samp(r), first, dealt)
    return with_normal_quantiles(rows.withColumn("variance", guarded(F.col("variance"))))


NORMAL_COLUMNS = ("variance", "volatility", *QUANTILE_COLUMNS)


def ewma_path(panel: DataFrame, decay: float, first: int) -> DataFrame:
    return with_ewma(panel, decay, first).where("variance IS NOT NULL").select("series_id", "pos", *NORMAL_COLUMNS)


def garch_filter_path(panel: DataFrame, first: int, omega: float, alpha: float, beta: float, scale: float = 100.0) -> DataFrame:
    """Variance at fixed parameters, in scaled units from the scaled sample variance of the
    first `first` returns; every later return is applied once."""
    x = F.col("simple_return") * scale
    rows = affine_scan(panel.select(*PANEL), "variance", beta, omega + alpha * (x * x), F.var_samp(x), first)
    rows = rows.withColumn("variance", F.col("variance") / scale**2)
    return with_normal_quantiles(rows).where("variance IS NOT NULL").select("series_id", "pos", *NORMAL_COLUMNS)


def one_window(values: Iterator[float], window: int, method: str = "linear") -> dict[str, float]:
    """Both historical forecasts from exactly one window of returns."""
    r = np.array(list(values), float)
    if len(r) != window:
        raise fail("INSUFFICIENT_HISTORY", f"The window needs {window} returns; it has {len(r)}.")
    if not np.isfinite(r).all():
        raise fail("INPUT_VALUE_INVALID", "A return is not finite.")
    q05, q01 = (float(np.quantile(r, p, method=method)) for p in (0.05, 0.01))
    v = float(np.var(r, ddof=1))
    return {"variance": v, "volatility": math.sqrt(v), "return_quantile_0_05": q05, "var_0_95": max(0.0, -q05), "return_quantile_0_01": q01, "var_0_99": max(0.0, -q01)}
