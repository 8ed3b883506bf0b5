"""Tables behind the report and its figures, from saved forecasts and evaluation tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.errors import fail
from riskloom.functions import scoring
from riskloom.operators import evaluation
from riskloom.operators import models as m
from riskloom.operators.evaluation import ALL, KEY

RMS_WINDOW, RMS_LEAST = 21, 5
COVERAGE_COLUMNS = ["expected_exception_probability", "exception_count", "exception_rate", "longest_exception_cluster", "kupiec_p_value", "christoffersen_independence_p_value", "conditional_coverage_p_value"]


#: Columns of the evaluation tables.
SCHEMAS = {
    "forecast_availability": evaluation.RESULT,
    "variance_scores": evaluation.RESULT,
    "quantile_scores": evaluation.QUANTILE_SCORES,
    "coverage_tests": evaluation.COVERAGE,
    "bootstrap_comparisons": evaluation.COMPARISONS,
    "period_breakdowns": evaluation.BREAKDOWNS,
}


def comparison_rows(comparisons: DataFrame, period: str, metric: str) -> DataFrame:
    """Comparisons over all series for one metric, candidates in name order."""
    chosen = (F.col("period") == period) & (F.col("series_id") == ALL) & (F.col("metric") == metric) & F.col("model_id").isin(*m.CANDIDATES)
    return comparisons.where(chosen).orderBy("model_id")


def series_comparisons(comparisons: DataFrame) -> DataFrame:
    """Per-series comparisons of the test period for the two headline metrics."""
    return comparisons.where((F.col("period") == "test") & (F.col("series_id") != ALL) & F.col("metric").isin("qlike", "pinball_loss_0_05"))


def verdict(lower: Column, upper: Column) -> Column:
    """Who is better when a whole interval of the difference lies on one side of zero."""
    return F.when(upper < 0, "candidate_better").when(lower > 0, "benchmark_better").otherwise("open")


def directions(comparisons: DataFrame, period: str, metric: str) -> DataFrame:
    """Candidates whose mean difference and whole interval lie below zero."""
    return comparison_rows(comparisons, period, metric).where("paired_count > 0 AND value < 0 AND interval_upper < 0").select("model_id")


def availability_pivot(availability: DataFrame, period: str = "test") -> DataFrame:
    """Counts per model over all series, one column a count, and the valid share."""
    names = ["total_eligible_target_dates", "valid_forecast_count", "failed_forecast_count", "unavailable_forecast_count"]
    rows = availability.where((F.col("period") == period) & (F.col("series_id") == ALL)).groupBy("model_id").pivot("metric", names).agg(F.first("value"))
    return rows.withColumn("valid_share", F.col("valid_forecast_count") / F.col("total_eligible_target_dates"))


def coverage_pivot(coverage: DataFrame, level: float, period: str = "test") -> DataFrame:
    rows = coverage.where((F.col("period") == period) & (F.col("confidence_level") == level))
    return rows.groupBy("series_id", "model_id").pivot("metric", COVERAGE_COLUMNS).agg(F.first("value"))


def calibration_summary(coverage: DataFrame, series: int, period: str = "test", level: float = 0.05) -> DataFrame:
    """Per model: rejected if any Kupiec p-value is under `level`, consistent if none is and
    every series has both tests, else incomplete."""
    rows = coverage.where((F.col("period") == period) & (F.col("metric") == "kupiec_p_value")).groupBy("model_id")
    rows = rows.agg(F.count("value").alias("valid_tests"), F.sum((F.col("value") < level).cast("bigint")).alias("rejections"))
    verdict = F.when(F.col("rejections") > 0, "rejected").when(F.col("valid_tests") == series * 2, "consistent").otherwise("incomplete")
    return rows.withColumn("rejections", F.coalesce("rejections", F.lit(0).cast("bigint"))).withColumn("verdict", verdict)


def diagnostics_summary(diagnostics: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Fits, converged fits, retries and failed forecasts per candidate."""
    yes = lambda c: F.sum(F.col(c).cast("bigint"))
    fits = diagnostics.groupBy("model_id").agg(F.count(F.lit(1)).alias("fits"), yes("converged").alias("converged"), yes("retry_used").alias("retries"))
    failed = forecasts.groupBy("model_id").agg(F.sum((F.col("status") == "failed").cast("bigint")).alias("failed_forecasts"))
    return fits.join(failed, "model_id", "left").fillna(0, ["failed_forecasts"])


def valid_values(forecasts: DataFrame, column: str) -> DataFrame:
    """Forecasts that are ok with a finite (and, for variances, positive) value."""
    rows = forecasts.where((F.col("status") == "ok") & scoring.finite(F.col(column)))
    return rows.where(F.col(column) > 0) if column == "variance" else rows


def model_history(forecasts: DataFrame, series: str, model: str) -> DataFrame:
    return forecasts.where((F.col("series_id") == series) & (F.col("model_id") == model)).orderBy("target_date")


def realized_on_forecast_dates(forecasts: DataFrame, realizations: DataFrame) -> DataFrame:
    return realizations.join(forecasts.select(*KEY).distinct(), list(KEY), "left_semi")


def realized_rms(realizations: DataFrame) -> DataFrame:
    """Root mean square return of the last RMS_WINDOW rows in percent, from RMS_LEAST rows on."""
    frame = Window.partitionBy("series_id").orderBy("target_date").rowsBetween(1 - RMS_WINDOW, 0)
    rms = F.when(F.count("squared_return").over(frame) >= RMS_LEAST, F.sqrt(F.avg("squared_return").over(frame)) * 100)
    return realizations.select("series_id", "target_date", (F.abs("simple_return") * 100).alias("absolute_return"), rms.alias("rolling_rms"))


def volatility_history(forecasts: DataFrame, realizations: DataFrame) -> DataFrame:
    rows = valid_values(forecasts, "variance").where(F.col("model_id").isin(*m.VARIANCE_MODELS)).select("series_id", "model_id", "target_date", (F.sqrt("variance") * 100).alias("volatility"))
    return rows.join(realized_rms(realized_on_forecast_dates(forecasts, realizations)), ["series_id", "target_date"])


def exception_history(forecasts: DataFrame, realizations: DataFrame) -> DataFrame:
    rows = valid_values(forecasts, "var_0_95").where(F.col("model_id").isin(*m.QUANTILE_MODELS)).select(*KEY, "model_id", "var_0_95")
    return rows.join(realizations.select(*KEY, "loss"), list(KEY)).where("loss > var_0_95")


def rolling_advantage(differences: DataFrame, window: int, periods: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Rolling mean of benchmark-relative differences (period, model_id, target_date, series_id,
    difference), averaged over series each day. A day counts only where all series of the
    candidate's benchmark have it; a window with a missing day has no value."""
    rows = differences.where(F.col("period").isin(*periods))
    kind = F.struct("model_id", "metric")
    told = rows.agg(F.countDistinct("series_id").alias("expected"), F.collect_set(kind).alias("kinds"))  # one row: a few models
    daily = rows.groupBy("model_id", "metric", "target_date").agg(F.countDistinct("series_id").alias("n"), F.avg("difference").alias("difference"))
    days = rows.select("target_date").distinct().withColumn("all", F.lit(1)).join(F.broadcast(told.withColumn("all", F.lit(1))), "all")
    calendar = days.select("target_date", "expected", F.explode("kinds").alias("kind")).select("target_date", "expected", "kind.*")
    full = calendar.join(daily, ["model_id", "metric", "target_date"], "left").withColumn("difference", F.when(F.col("n") == F.col("expected"), F.col("difference")))
    frame = Window.partitionBy("model_id", "metric").orderBy("target_date").rowsBetween(1 - window, 0)
    return full.select("model_id", "metric", "target_date", F.when(F.count("difference").over(frame) == window, F.avg("difference").over(frame)).alias("rolling_difference"))


#: Columns of a figure's width.
PIXELS = 720


def pixel_columns(points: DataFrame, keys: list[str], width: int = PIXELS) -> DataFrame:
    """points (keys, x, y) reduced to what a figure of `width` columns shows of them: of each
    key and column the first, last, lowest and highest point. Columns are of one scale over all
    keys. At most 4 * width rows a key are left, whatever there was."""
    span = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1")).withColumn("all", F.lit(1))
    placed = points.withColumn("all", F.lit(1)).join(F.broadcast(span), "all")
    column = F.floor((F.col("x") - F.col("x0")) * width / (F.col("x1") - F.col("x0") + 1))
    point = F.struct("x", "y")
    ends = [F.min(point), F.max(point), F.min_by(point, F.struct("y", "x")), F.max_by(point, F.struct("y", "x"))]
    kept = placed.where("y IS NOT NULL").groupBy(*keys, column.alias("_column")).agg(F.array_distinct(F.array(*ends)).alias("kept"))
    return kept.select(*keys, F.explode("kept").alias("p")).select(*keys, "p.x", "p.y")


def calibration_points(coverage: DataFrame) -> DataFrame:
    """Exception rate of the test period per series, model and level against the nominal one."""
    rows = coverage.where((F.col("period") == "test") & (F.col("metric") == "exception_rate"))
    return rows.select("series_id", "model_id", "confidence_level", F.col("tail_probability").alias("nominal_rate"), F.col("value").alias("exception_rate"))


def period_context(realizations: DataFrame) -> DataFrame:
    """First and last target date of each period; one date in two periods is an error."""
    days = realizations.select("period", "target_date").distinct()
    twice = days.groupBy("target_date").count().where("count > 1").limit(1).count()
    if twice:
        raise fail("ARTIFACT_RECONCILIATION_FAILED", "A date lies in two periods.")
    return days.groupBy("period").agg(F.min("target_date").alias("first_date"), F.max("target_date").alias("last_date"))


def reconciliation(tables: dict[str, DataFrame], years: Iterable[int] | None = None) -> DataFrame:
    """Faults between the evaluation tables: rows (fault, n), none if they agree. years: those
    of the test period, which alone may have a breakdown."""
    a, q, c, b = (tables[k] for k in ("forecast_availability", "quantile_scores", "coverage_tests", "bootstrap_comparisons"))
    v = tables["variance_scores"]
    group = ["experiment_id", "period", "series_id", "model_id"]
    wide = a.groupBy(*group).pivot("metric", ["total_eligible_target_dates", "valid_forecast_count", "failed_forecast_count", "unavailable_forecast_count"]).agg(F.first("value"))
    uneven = wide.where("NOT (total_eligible_target_dates <=> valid_forecast_count + failed_forecast_count + unavailable_forecast_count)")
    scores = v.select(*group, "metric", "observation_count").unionByName(q.select(*group, "metric", "observation_count"))
    off = scores.join(wide, group, "left").where("valid_forecast_count IS NULL OR observation_count <> valid_forecast_count")
    candidate = scores.select(*group, "metric", F.col("observation_count").alias("have"))
    base = scores.select("experiment_id", "period", "series_id", F.col("model_id").alias("benchmark_model_id"), "metric", F.col("observation_count").alias("base"))
    pairs = b.join(candidate, [*group, "metric"], "left").join(base, ["experiment_id", "period", "series_id", "benchmark_model_id", "metric"], "left")
    over = pairs.where("paired_count > least(coalesce(have, 0), coalesce(base, 0))")
    tails = F.create_map(*[F.lit(x) for t in scoring.TAILS for x in (t[4], t[0])])
    scored = q.select(*group, F.col("metric").alias("score_metric"), "confidence_level", "tail_probability", F.col("observation_count").alias("scored"))
    mixed = c.withColumn("score_metric", tails[F.col("tail_probability")]).join(scored, [*group, "score_metric", "confidence_level", "tail_probability"], "left").where("scored IS NULL OR scored <> observation_count")
    named = {
        "counts do not add up": uneven,
        "scores do not match valid forecasts": off,
        "pairs exceed scores": over,
        "coverage does not match scores": mixed,
        "a comparison counts other observations than pairs": b.where("NOT (observation_count <=> paired_count)"),
        "a period is neither validation nor test": reduce(DataFrame.unionByName, [t.select("period") for t in (a, v, q, c, b)]).where(~F.coalesce(F.col("period").isin("validation", "test"), F.lit(False))),
    }
    if years is not None:
        named["a breakdown is of no declared year"] = tables["period_breakdowns"].where(~F.coalesce(F.col("period").isin(*[f"test_{y}" for y in years]), F.lit(False)))
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("fault"), "n") for k, rows in named.items()]).where("n > 0")


def check_reconciled(tables: dict[str, DataFrame], years: Iterable[int] | None = None) -> None:
    """Raises if an evaluation table lacks its columns or the tables do not agree."""
    for name, columns in SCHEMAS.items():
        if tuple(tables[name].columns) != columns:
            raise fail("WINDOW_ALIGNMENT_ERROR", f"{name} does not have its columns.")
    found = reconciliation(tables, years).collect()  # a row a kind of fault
    if found:
        raise fail("ARTIFACT_RECONCILIATION_FAILED", "; ".join(f"{r.fault} ({r.n})" for r in sorted(found)) + ".")
