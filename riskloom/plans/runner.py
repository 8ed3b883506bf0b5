"""Model runs: panel to windows, forecasts, realizations and fit diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import __version__
from riskloom.config import Config
from riskloom.errors import fail
from riskloom.functions import ids
from riskloom.operators import evaluation, garch, models, windows
from riskloom.operators.panel import PANEL

# Columns of the forecasts and fit diagnostics tables.
FORECASTS = ("experiment_id", "forecast_id", "series_id", "model_id", "model_version", "fit_id", "forecast_origin", "target_date", "variance", "volatility", "return_quantile_0_05", "var_0_95", "return_quantile_0_01", "var_0_99", "status", "error_code", "warning_codes")
DIAGNOSTICS = ("fit_id", "series_id", "model_id", "fit_origin", "train_start", "train_end", "observation_count", "omega", "alpha", "beta", "degrees_of_freedom", "parameter_persistence", "converged", "optimizer_status", "retry_used", "runtime_seconds", "scaling_factor", "warning_codes")
_TYPES = {
    "fit_id": "string", "series_id": "string", "model_id": "string", "fit_origin": "date", "train_start": "date", "train_end": "date", "observation_count": "bigint", "converged": "boolean",
    "optimizer_status": "string", "retry_used": "boolean", "warning_codes": "string",
}
DIAGNOSTIC_SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'double')}" for c in DIAGNOSTICS)
VALUES = FORECASTS[8:14]


@dataclass(frozen=True)
class Artifacts:
    experiment_windows: DataFrame
    realizations: DataFrame
    forecasts: DataFrame
    fit_diagnostics: DataFrame


def _ids(rows: DataFrame, config: Config, checksum: str, origin: Column, start: Column, end: Column) -> DataFrame:
    """Adds fit_id from the fit's own dates, and forecast_id."""
    name = config.experiment.experiment_id
    rows = rows.withColumn("fit_id", ids.fit_id(name, checksum, __version__, F.col("series_id"), F.col("model_id"), origin, start, end))
    return rows.withColumn("forecast_id", ids.forecast_id(name, F.col("fit_id"), F.col("series_id"), F.col("model_id"), F.col("forecast_origin"), F.col("target_date")))


def finished(rows: DataFrame, config: Config) -> DataFrame:
    """FORECASTS columns; a row without status is ok, and a failed one has no values."""
    missing = [c for c in VALUES if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in missing})
    if "status" not in rows.columns:
        rows = rows.withColumn("error_code", _variance_error(F.col("variance"))).withColumn("status", F.when(F.col("error_code").isNull(), "ok").otherwise("failed"))
        rows = rows.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in VALUES})
    fixed = {"experiment_id": F.lit(config.experiment.experiment_id), "model_version": F.lit(__version__), "warning_codes": F.lit("[]")}
    return rows.withColumns(fixed).select(*FORECASTS)


def _variance_error(v: Column) -> Column:
    """The failure of a row that has a variance; rows without one (quantile models) have none."""
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(bad, "NONFINITE_VARIANCE").when(v <= 0, "NONPOSITIVE_VARIANCE")


def _table(rows: DataFrame) -> DataFrame:
    return rows.select(*windows.WINDOWS)


def realizations(panel: DataFrame, config: Config) -> DataFrame:
    """Realizations begin where the shorter of the two historical windows has its first origin."""
    h = config.historical
    return windows.realizations(panel, min(h.variance_window, h.var_window) - 1, config.periods)


def historical(panel: DataFrame, config: Config, checksum: str = "") -> Artifacts:
    h = config.historical
    parts, grids = [], []
    for model, size, values, keep in (
        (models.HISTORICAL_VARIANCE, h.variance_window, models.with_variance(panel, h.variance_window), ("variance", "volatility")),
        (models.HISTORICAL_SIMULATION, h.var_window, models.with_simulation(panel, h.var_window, h.quantile_method), models.QUANTILE_COLUMNS),
    ):
        grids.append(_table(windows.trailing_windows(panel, size, config.periods, model)))
        rows = _ids(windows.trailing_windows(values, size, config.periods, model, keep), config, checksum, F.col("forecast_origin"), F.col("train_start"), F.col("train_end"))
        parts.append(finished(rows, config))
    empty = panel.sparkSession.createDataFrame([], DIAGNOSTIC_SCHEMA)
    return Artifacts(grids[0].unionByName(grids[1]), realizations(panel, config), parts[0].unionByName(parts[1]), empty)


def ewma(panel: DataFrame, config: Config, checksum: str = "") -> Artifacts:
    e = config.ewma
    grid = windows.expanding_windows(panel, e.initialization_window, config.periods, models.EWMA)
    first = grid.groupBy("series_id").agg(F.min_by(F.struct("forecast_origin", "train_start", "train_end"), "forecast_origin").alias("first"))
    rows = windows.expanding_windows(models.with_ewma(panel, e.lambda_, e.initialization_window), e.initialization_window, config.periods, models.EWMA, models.NORMAL_COLUMNS)
    start = F.first(F.struct("forecast_origin", "train_start", "train_end")).over(Window.partitionBy("series_id").orderBy("pos"))
    rows = rows.withColumn("first", start)
    rows = _ids(rows, config, checksum, F.col("first.forecast_origin"), F.col("first.train_start"), F.col("first.train_end"))
    fits = first.withColumn("model_id", F.lit(models.EWMA)).select(
        ids.fit_id(config.experiment.experiment_id, checksum, __version__, F.col("series_id"), F.col("model_id"), F.col("first.forecast_origin"), F.col("first.train_start"), F.col("first.train_end")).alias("fit_id"),
        "series_id",
        "model_id",
        F.col("first.forecast_origin").alias("fit_origin"),
        F.col("first.train_start").alias("train_start"),
        F.col("first.train_end").alias("train_end"),
        F.lit(e.initialization_window).cast("bigint").alias("observation_count"),
        *[F.lit(None).cast("double").alias(c) for c in ("omega", "alpha", "beta", "degrees_of_freedom")],
        F.lit(e.lambda_).alias("parameter_persistence"),
        F.lit(True).alias("converged"),
        F.lit("not_applicable_recursive_model").alias("optimizer_status"),
        F.lit(False).alias("retry_used"),
        F.lit(0.0).alias("runtime_seconds"),
        F.lit(1.0).alias("scaling_factor"),
        F.lit("[]").alias("warning_codes"),
    )
    return Artifacts(_table(grid), realizations(panel, config), finished(rows, config), fits)


def garch_candidates(panel: DataFrame, config: Config, checksum: str = "", optimiser=None, keep: bool = True) -> Artifacts:
    """keep: the fits are read for forecasts and diagnostics, so they are kept; a caller that
    reads one of them only does without."""
    g = config.garch
    grid = windows.refit_windows(panel, g.estimation_window, g.refit_every_origins, config.periods, list(garch.MODELS))
    fitted = garch.garch_rows(panel, g, config.periods, optimiser)
    fitted = fitted.cache() if keep else fitted
    rows = _ids(fitted, config, checksum, F.col("fit_origin"), F.col("fit_start"), F.col("fit_origin"))
    fits = rows.where(F.col("forecast_origin") == F.col("fit_origin")).withColumn("train_start", F.col("fit_start")).withColumn("train_end", F.col("fit_origin")).withColumn("warning_codes", F.lit("[]"))
    return Artifacts(_table(grid), realizations(panel, config), finished(rows, config), fits.select(*DIAGNOSTICS))


def union(parts: list[Artifacts]) -> Artifacts:
    """Several runs over one panel; they share their realizations."""
    both = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    return Artifacts(both("experiment_windows"), parts[0].realizations, both("forecasts"), both("fit_diagnostics"))


def benchmarks_and_ewma(panel: DataFrame, config: Config, checksum: str = "") -> Artifacts:
    return union([historical(panel, config, checksum), ewma(panel, config, checksum)])


def by_date(panel: DataFrame, config: Config) -> DataFrame:
    """A row a target date: (KEY, period, simple_return, squared_return, loss) and for each
    model of benchmarks_and_ewma a struct of VALUES, status and error_code, null where its
    window has no forecast. What happened is the next row of the series, so a panel dealt by
    series meets no join with realizations: evaluation.rows_of gives the rows that
    evaluation.joined gives."""
    h, e = config.historical, config.ewma
    series = Window.partitionBy("series_id").orderBy("pos")
    none = F.lit(None).cast("double")

    def model(least: int, columns: tuple[str, ...]) -> Column:
        values = {c: F.col(c) if c in columns else none for c in VALUES}
        error = _variance_error(values["variance"])
        told = [F.when(error.isNull(), v).alias(c) for c, v in values.items()]
        return F.when(F.col("pos") >= least - 1, F.struct(*told, F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error_code")))

    # Only variances go through the sorted windows, which come last, so nothing runs twice.
    rows = models.with_ewma(panel.select(*PANEL), e.lambda_, e.initialization_window, dealt=True).withColumnRenamed("variance", "_ewma").select(*PANEL, "_ewma")
    rows = models.with_variance(rows, h.variance_window).withColumnRenamed("variance", "_historical").drop("volatility")
    rows = rows.withColumns({"_target": F.lead("date").over(series), "_realized": F.lead("simple_return").over(series)})
    rows = models.with_simulation(rows, h.var_window, h.quantile_method)
    rows = rows.withColumn("period", windows.period_of(F.col("_target"), config.periods)).where(F.col("period").isin(*evaluation.PERIODS))
    rows = rows.withColumn(models.HISTORICAL_SIMULATION, model(h.var_window, models.QUANTILE_COLUMNS))
    rows = models.with_normal_quantiles(rows.withColumn("variance", F.col("_historical"))).withColumn(models.HISTORICAL_VARIANCE, model(h.variance_window, ("variance", "volatility")))
    rows = models.with_normal_quantiles(rows.withColumn("variance", F.col("_ewma"))).withColumn(models.EWMA, model(e.initialization_window, models.NORMAL_COLUMNS))
    rows = rows.select("series_id", F.col("date").alias("forecast_origin"), F.col("_target").alias("target_date"), "period", F.col("_realized").alias("simple_return"), *evaluation.MODELS_BY_DATE)
    r = F.col("simple_return")
    return rows.withColumns({"squared_return": r * r, "loss": -r})


def available_models(panel: DataFrame, config: Config, checksum: str = "", optimiser=None) -> Artifacts:
    return union([historical(panel, config, checksum), ewma(panel, config, checksum), garch_candidates(panel, config, checksum, optimiser)])


def evaluated(panel: DataFrame, config: Config, checksum: str = "") -> tuple[Artifacts, dict[str, DataFrame]]:
    found = available_models(panel, config, checksum)
    return found, evaluation.evaluate(found.forecasts, found.realizations, config)


def artifact_faults(found: Artifacts) -> DataFrame:
    """Disagreements between windows, forecasts, realizations and fits: rows (fault, n), none if
    they agree."""
    f, r, w, d = found.forecasts, found.realizations, found.experiment_windows, found.fit_diagnostics
    key = list(evaluation.KEY)
    fitted = f.where(F.col("model_id").isin(*models.CANDIDATES)).select("fit_id").distinct()
    faults = {
        "an origin is not before its target": f.where("forecast_origin >= target_date"),
        "a window does not end at its origin": w.where("train_end <> forecast_origin OR forecast_origin >= target_date"),
        "a forecast has no window": f.join(w, [*key, "model_id"], "left_anti"),
        "a window has no forecast": w.join(f, [*key, "model_id"], "left_anti"),
        "a forecast id repeats": f.groupBy("forecast_id").count().where("count > 1"),
        "a forecast key repeats": f.groupBy(*key, "model_id").count().where("count > 1"),
        "a realization key repeats": r.groupBy(*key).count().where("count > 1"),
        "a forecast has no realization": f.join(r, key, "left_anti"),
        "a candidate's fit has no diagnostics": fitted.join(d, "fit_id", "left_anti"),
        "a fit's diagnostics repeat": d.groupBy("fit_id").count().where("count > 1"),
        "a fit has no forecasts": d.join(fitted, "fit_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("fault"), "n") for k, rows in faults.items()]).where("n > 0")


def check_artifacts(found: Artifacts) -> None:
    """Raises unless windows, forecasts, realizations and fits agree with each other."""
    f, r, w, d = found.forecasts, found.realizations, found.experiment_windows, found.fit_diagnostics
    for name, table, columns in (("experiment_windows", w, windows.WINDOWS), ("realizations", r, windows.REALIZATIONS), ("forecasts", f, FORECASTS), ("fit_diagnostics", d, DIAGNOSTICS)):
        if tuple(table.columns) != tuple(columns):
            raise fail("WINDOW_ALIGNMENT_ERROR", f"{name} does not have its columns.")
    told = sorted(artifact_faults(found).collect())  # a row a kind of fault
    if told:
        raise fail("WINDOW_ALIGNMENT_ERROR", f"The artifacts don't agree: {'; '.join(f'{t.fault} ({t.n})' for t in told)}.")
