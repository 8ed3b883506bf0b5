"""The engine's queries over the star-schema tables and their DuckDB SQL.

All run over the whole derived panel with one profile. Doubles are rounded to nine decimals on
both sides, since sums run in different orders.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.errors import RiskError
from riskloom.functions import ids, scoring
from riskloom.functions.special import Z_01, Z_05, standardised_quantiles, student_t_quantiles
from riskloom.operators import evaluation, garch, models, panel, reporting, windows
from riskloom.plans import panels, runner
from riskloom.plans.panels import PROFILE, PROXY, WEIGHTS, lineitem_panel
from riskloom.session import importable
from riskloom.sources import fixture

DIGITS = 9
P = PROFILE.periods
H = PROFILE.historical
GARCH = {"omega": 0.05, "alpha": 0.05, "beta": 0.90}
CHECKSUM = "0" * 64


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _benchmarks(spark: SparkSession, d: str) -> runner.Artifacts:
    return runner.benchmarks_and_ewma(lineitem_panel(spark, d), PROFILE, CHECKSUM)


def _joined(spark: SparkSession, d: str) -> DataFrame:
    found = _benchmarks(spark, d)
    return evaluation.joined(found.forecasts, found.realizations)


def _name() -> str:
    return PROFILE.experiment.experiment_id


# -- queries ------------------------------------------------------------------------------


def panel_returns(spark, d):
    return rounded(panel.with_positions(panels.instrument_returns(spark, d).withColumn("series_pos", F.array_position(F.array(*map(F.lit, panels.NAMES)), F.col("series_id")).cast("int") - 1)))


def proxy_series(spark, d):
    return rounded(panel.with_proxy(panels.wide_returns(spark, d), WEIGHTS, PROXY))


def index_faults(spark, d):
    """Faults of the order dates as an index in key order (they repeat and are not sorted)."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("pos"), F.col("o_orderdate").cast("date").alias("date"))
    return panel.index_faults(rows)


def trailing_windows(spark, d):
    return windows.trailing_windows(lineitem_panel(spark, d), H.variance_window, P, models.HISTORICAL_VARIANCE).select(*windows.WINDOWS)


def expanding_windows(spark, d):
    return windows.expanding_windows(lineitem_panel(spark, d), PROFILE.ewma.initialization_window, P, models.EWMA).select(*windows.WINDOWS)


def refit_windows(spark, d):
    g = PROFILE.garch
    return windows.refit_windows(lineitem_panel(spark, d), g.estimation_window, g.refit_every_origins, P, [models.GARCH_GAUSSIAN, models.GARCH_STUDENT_T]).select(*windows.WINDOWS)


def realizations(spark, d):
    return rounded(runner.realizations(lineitem_panel(spark, d), PROFILE))


def hist_variance_path(spark, d):
    return rounded(models.variance_path(lineitem_panel(spark, d), H.variance_window))


def _simulation(method: str):
    def query(spark, d):
        return rounded(models.simulation_path(lineitem_panel(spark, d), H.var_window, method))

    return query


def ewma_path(spark, d):
    e = PROFILE.ewma
    return rounded(models.ewma_path(lineitem_panel(spark, d), e.lambda_, e.initialization_window))


def garch_filter_path(spark, d):
    return rounded(models.garch_filter_path(lineitem_panel(spark, d), 60, GARCH["omega"], GARCH["alpha"], GARCH["beta"]))


def forecast_union(spark, d):
    return rounded(_benchmarks(spark, d).forecasts.drop("forecast_id", "fit_id"))


def forecast_ids(spark, d):
    return _benchmarks(spark, d).forecasts.select("series_id", "model_id", "forecast_origin", "fit_id", "forecast_id")


def ewma_diagnostics(spark, d):
    return runner.ewma(lineitem_panel(spark, d), PROFILE, CHECKSUM).fit_diagnostics


def availability(spark, d):
    return evaluation.availability(_joined(spark, d), _name())


def variance_scores(spark, d):
    return rounded(evaluation.score_table(evaluation.variance_observations(_joined(spark, d)), _name()))


def quantile_scores(spark, d):
    return rounded(evaluation.score_table(evaluation.quantile_observations(_joined(spark, d)), _name(), ("confidence_level", "tail_probability")))


_GROUP = ["period", "series_id", "model_id", "confidence_level", "tail_probability"]


def exception_counts(spark, d):
    return evaluation.exception_counts(evaluation.quantile_observations(_joined(spark, d)), _GROUP)


def coverage_statistics(spark, d):
    rows = evaluation.coverage_wide(evaluation.exception_counts(evaluation.quantile_observations(_joined(spark, d)), _GROUP))
    return rounded(rows.select(*_GROUP, "exception_rate", "kupiec_lr", "christoffersen_independence_lr", "conditional_coverage_lr", "conditional_coverage_p_value", "christoffersen_status"))


def coverage_tests(spark, d):
    return rounded(evaluation.coverage_table(evaluation.quantile_observations(_joined(spark, d)), _name()))


def _pairs(spark, d) -> DataFrame:
    rows = _joined(spark, d).cache()
    return evaluation.all_pairs(evaluation.variance_observations(rows), evaluation.quantile_observations(rows))


def paired_differences(spark, d):
    return rounded(_pairs(spark, d))


def bootstrap_point_estimates(spark, d):
    return rounded(evaluation.point_estimates(_pairs(spark, d)))


def bootstrap_intervals(spark, d):
    rows = _joined(spark, d).cache()
    return evaluation.comparisons(evaluation.variance_observations(rows), evaluation.quantile_observations(rows), PROFILE)


def period_breakdowns(spark, d):
    rows = _joined(spark, d).cache()
    return rounded(evaluation.breakdowns(rows, evaluation.variance_observations(rows), evaluation.quantile_observations(rows), PROFILE))


def rolling_advantage(spark, d):
    return rounded(reporting.rolling_advantage(_pairs(spark, d).where("metric = 'qlike'"), 20))


def realized_rms(spark, d):
    return rounded(reporting.realized_rms(runner.realizations(lineitem_panel(spark, d), PROFILE)))


def availability_pivot(spark, d):
    return rounded(reporting.availability_pivot(availability(spark, d)))


def coverage_pivot(spark, d):
    return rounded(reporting.coverage_pivot(evaluation.coverage_table(evaluation.quantile_observations(_joined(spark, d)), _name()), 0.95))


def calibration_points(spark, d):
    return rounded(reporting.calibration_points(evaluation.coverage_table(evaluation.quantile_observations(_joined(spark, d)), _name())))


def calibration_summary(spark, d):
    return reporting.calibration_summary(evaluation.coverage_table(evaluation.quantile_observations(_joined(spark, d)), _name()), len(PROFILE.series()))


def volatility_history(spark, d):
    found = _benchmarks(spark, d)
    return rounded(reporting.volatility_history(found.forecasts, found.realizations))


def exception_history(spark, d):
    found = _benchmarks(spark, d)
    return rounded(reporting.exception_history(found.forecasts, found.realizations))


def period_context(spark, d):
    return reporting.period_context(runner.realizations(lineitem_panel(spark, d), PROFILE))


TAMPERED = f"model_id = '{models.EWMA}' AND period = 'test'"


def reconcile_counts(spark, d):
    """Reconciliation of tables whose quantile scores count one observation too many for one
    model and period."""
    found = _benchmarks(spark, d)
    tables = evaluation.evaluate(found.forecasts, found.realizations, PROFILE)
    more = F.when(F.expr(TAMPERED), F.col("observation_count") + 1).otherwise(F.col("observation_count"))
    return reporting.reconciliation(tables | {"quantile_scores": tables["quantile_scores"].withColumn("observation_count", more)})


def _filtered(spark, d) -> DataFrame:
    """Forecasts of the recursion at fixed GARCH parameters. Every seventh variance is made zero
    and every eleventh not a number, so the guard fails them."""
    rows = lineitem_panel(spark, d)
    path = models.garch_filter_path(rows, 60, GARCH["omega"], GARCH["alpha"], GARCH["beta"])
    v = F.when(F.col("pos") % 7 == 0, 0.0).when(F.col("pos") % 11 == 0, float("nan")).otherwise(F.col("variance"))
    grid = windows.expanding_windows(rows, 60, P, models.GARCH_GAUSSIAN)
    found = grid.join(path.withColumn("variance", v), ["series_id", "pos"]).withColumns({"fit_id": F.lit("fixed"), "forecast_id": F.concat_ws(":", "series_id", "pos")})
    return runner.finished(found, PROFILE)


def variance_guard(spark, d):
    return rounded(_filtered(spark, d).select("series_id", "forecast_origin", "variance", "var_0_95", "status", "error_code"))


def _joined_garch(spark: SparkSession, d: str) -> DataFrame:
    found = _benchmarks(spark, d)
    return evaluation.joined(found.forecasts.unionByName(_filtered(spark, d)), found.realizations)


def _pairs_garch(spark, d) -> DataFrame:
    rows = _joined_garch(spark, d)
    return evaluation.all_pairs(evaluation.variance_observations(rows), evaluation.quantile_observations(rows))


def availability_with_garch(spark, d):
    return evaluation.availability(_joined_garch(spark, d), _name())


def variance_scores_with_garch(spark, d):
    return rounded(evaluation.score_table(evaluation.variance_observations(_joined_garch(spark, d)), _name()))


def quantile_scores_with_garch(spark, d):
    return rounded(evaluation.score_table(evaluation.quantile_observations(_joined_garch(spark, d)), _name(), ("confidence_level", "tail_probability")))


def coverage_tests_with_garch(spark, d):
    return rounded(evaluation.coverage_table(evaluation.quantile_observations(_joined_garch(spark, d)), _name()))


def paired_differences_with_garch(spark, d):
    return rounded(_pairs_garch(spark, d))


def bootstrap_point_estimates_with_garch(spark, d):
    return rounded(evaluation.point_estimates(_pairs_garch(spark, d)))


def period_breakdowns_with_garch(spark, d):
    rows = _joined_garch(spark, d)
    return rounded(evaluation.breakdowns(rows, evaluation.variance_observations(rows), evaluation.quantile_observations(rows), PROFILE))


def comparison_rows(spark, d):
    """Comparisons over all series by QLIKE in the test period."""
    return rounded(reporting.comparison_rows(evaluation.point_estimates(_pairs_garch(spark, d)), "test", "qlike"))


def candidate_directions(spark, d):
    """Candidates better than the benchmark by QLIKE in the validation and test periods, with the
    normal bound of the mean difference for the upper end of the interval."""
    top = F.avg("difference") + 1.96 * F.stddev_samp("difference") / F.sqrt(F.count(F.lit(1)))
    bounds = [F.count(F.lit(1)).alias("paired_count"), F.avg("difference").alias("value"), top.alias("interval_upper")]
    rows = evaluation.with_all(_pairs_garch(spark, d), ["period", "model_id", "benchmark_model_id", "metric"], bounds)
    parts = [reporting.directions(rows, period, metric).select(F.lit(period).alias("period"), F.lit(metric).alias("metric"), "model_id") for period in evaluation.PERIODS for metric in ("qlike", "pinball_loss_0_05")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def diagnostics_summary(spark, d):
    found = runner.ewma(lineitem_panel(spark, d), PROFILE, CHECKSUM)
    return reporting.diagnostics_summary(found.fit_diagnostics, found.forecasts)


LACKING = "series_id = 'A' AND period = 'validation'"


def artifact_faults(spark, d):
    """Faults of artifacts that lack one series' realizations of a period and all diagnostics."""
    found = _benchmarks(spark, d)
    return runner.artifact_faults(runner.Artifacts(found.experiment_windows, found.realizations.where(f"NOT ({LACKING})"), found.forecasts.cache(), found.fit_diagnostics.limit(0)))


def parameter_checks(spark, d):
    """The check of GARCH parameters on combinations made from supplier keys, with its code."""

    def codes(parts):
        for rows in parts:
            yield rows.assign(code=[_code(*r) for r in rows[["omega", "alpha", "beta", "degrees_of_freedom", "student"]].itertuples(index=False)])

    importable(spark)
    k = F.col("s_suppkey").cast("bigint")
    columns = [((k % 5) / 10).alias("omega"), ((k % 4) / 5).alias("alpha"), ((k % 7) / 8).alias("beta"), F.when(k % 3 > 0, (k % 6).cast("double")).alias("degrees_of_freedom"), (k % 2 == 0).alias("student")]
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("s_suppkey"), *columns)
    return rows.mapInPandas(codes, "s_suppkey bigint, omega double, alpha double, beta double, degrees_of_freedom double, student boolean, code string").select("s_suppkey", "code")


def _code(omega: float, alpha: float, beta: float, degrees_of_freedom: float, student: bool) -> str:
    try:
        garch.check_parameters(garch.Parameters(omega, alpha, beta, None if degrees_of_freedom != degrees_of_freedom else degrees_of_freedom), student, 1e-8)
    except RiskError as e:
        return e.code
    return "ok"


def garch_fits(spark, d):
    return runner.garch_candidates(lineitem_panel(spark, d), PROFILE, CHECKSUM).fit_diagnostics


def garch_forecasts(spark, d):
    return runner.garch_candidates(lineitem_panel(spark, d), PROFILE, CHECKSUM).forecasts


#: Parameters of the stored fits: of both models, and the degrees of freedom of one.
STORED = garch.Parameters(0.05, 0.05, 0.90)
STORED_TAIL = 8.0


def _stored(scaled, start):
    return replace(STORED, degrees_of_freedom=start.degrees_of_freedom and STORED_TAIL), True, "stored"


def garch_stored_forecasts(spark, d):
    """Forecasts of both models whose every fit gives the stored parameters: refit windows, the
    variances of a window, the state, its advance and the quantiles."""
    rows = runner.garch_candidates(lineitem_panel(spark, d), PROFILE, CHECKSUM, _stored).forecasts
    return rounded(rows.select("series_id", "model_id", "forecast_origin", "target_date", *runner.VALUES, "status", "error_code"))


def garch_stored_likelihoods(spark, d):
    """Log-likelihoods of the stored parameters over every refit window, for both densities."""
    g = PROFILE.garch
    rows = windows.refit_chunks(lineitem_panel(spark, d), g.estimation_window, g.refit_every_origins, P, garch.CHUNK_FITS)
    return rounded(garch.likelihoods_by_window(rows, g, [STORED, replace(STORED, degrees_of_freedom=STORED_TAIL)]))


def quantiles_of_t(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select((F.pmod("s_suppkey", F.lit(60)) / 2 + 2.5).alias("degrees_of_freedom")).distinct()
    return rounded(rows.withColumn("q", student_t_quantiles("degrees_of_freedom")).select("degrees_of_freedom", "q.q05", "q.q01"))


def synthetic_fixture(spark, d):
    """The fixture's whole calendar with its returns, and all orders, their keys as positions on it."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return rounded(fixture.returns_at(rows, "o_orderkey"))


def variance_gauntlet(spark, d):
    """Scores of one variance forecast against every return of the panel."""
    v, r = F.lit(0.04), F.col("simple_return")
    rows = lineitem_panel(spark, d).select("series_id", "pos", scoring.qlike(v, r * r).alias("qlike"), scoring.pinball(F.lit(-0.03), r, 0.05).alias("pinball"), scoring.exception(-r, F.lit(0.03)).alias("exception"))
    return rounded(rows)


def canonical_ids(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_name", F.expr("date_add(date'2020-01-01', cast(n_nationkey as int))").alias("day"))
    return rows.select("n_name", ids.id_column("x_", {"name": F.col("n_name"), "day": ids.midnight(F.col("day"))}).alias("id"))


# -- a panel with a series a supplier: it grows with the tables -----------------------------


def _supplier_dates(spark: SparkSession, d: str) -> DataFrame:
    return runner.by_date(panels.supplier_panel(spark, d), PROFILE)


def _supplier_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rows_of(_supplier_dates(spark, d))


def supplier_panel(spark, d):
    return rounded(panels.supplier_panel(spark, d).drop("series_pos"))


def supplier_variance_scores(spark, d):
    return rounded(evaluation.score_table(evaluation.variance_observations(_supplier_rows(spark, d)), _name()))


def supplier_quantile_scores(spark, d):
    return rounded(evaluation.score_table(evaluation.quantile_observations(_supplier_rows(spark, d)), _name(), ("confidence_level", "tail_probability")))


def supplier_exception_counts(spark, d):
    return evaluation.exception_counts(evaluation.quantile_observations(_supplier_rows(spark, d)), _GROUP)


def _supplier_pairs(spark, d) -> DataFrame:
    return evaluation.pairs_of(_supplier_dates(spark, d))


def supplier_point_estimates(spark, d):
    # The pairs are read three times: for the series, the brackets and what lies in them.
    pairs = _supplier_pairs(spark, d).select("period", "series_id", "model_id", "benchmark_model_id", "metric", "difference").cache()
    return rounded(evaluation.point_estimates(pairs))


def supplier_directions(spark, d):
    """For each supplier, candidate, period and metric: the mean difference and its normal
    bounds, and which side both bounds are on."""
    mean, n = F.avg("difference"), F.count(F.lit(1))
    half = 1.96 * F.stddev_samp("difference") / F.sqrt(n)
    rows = _supplier_pairs(spark, d).groupBy("period", "series_id", "model_id", "benchmark_model_id", "metric").agg(n.alias("paired_count"), mean.alias("value"), (mean - half).alias("interval_lower"), (mean + half).alias("interval_upper"))
    return rounded(rows.withColumn("verdict", reporting.verdict(F.col("interval_lower"), F.col("interval_upper"))))


def supplier_stored_forecasts(spark, d):
    rows = runner.garch_candidates(panels.supplier_panel(spark, d), PROFILE, CHECKSUM, _stored, keep=False).forecasts
    return rounded(rows.select("series_id", "model_id", "forecast_origin", "target_date", *runner.VALUES, "status", "error_code"))


def supplier_pixels(spark, d):
    """What a figure shows of every supplier's weighted volatility."""
    path = models.with_ewma(panels.supplier_panel(spark, d), PROFILE.ewma.lambda_, PROFILE.ewma.initialization_window)
    points = path.where("variance IS NOT NULL").select("series_id", F.unix_date("date").alias("x"), F.round("volatility", DIGITS).alias("y"))
    return reporting.pixel_columns(points, ["series_id"], 40)


def _planted(series: str, year: int) -> str:
    return f"series_id = '{series}' AND model_id = '{models.EWMA}' AND year(target_date) = {year}"


def every_artifact_fault(spark, d):
    """Every fault of the artifacts, planted in places of its own."""
    found = _benchmarks(spark, d)
    f, r, w, t = found.forecasts.cache(), found.realizations, found.experiment_windows, found.fit_diagnostics  # read by each fault
    f = f.withColumn("forecast_origin", F.when(F.expr(_planted("A", 1999)), F.date_add("target_date", 1)).otherwise(F.col("forecast_origin")))
    w = w.withColumn("train_end", F.when(F.expr(_planted("N", 1999)), F.date_add("target_date", 1)).otherwise(F.col("train_end")))
    w = w.where(f"NOT ({_planted('R', 1999)})")
    f = f.where(f"NOT ({_planted('A', 2000)})")
    f = f.withColumn("forecast_id", F.when(F.expr(_planted("N", 2000)), "same").otherwise(F.col("forecast_id")))
    f = f.unionByName(f.where(_planted("R", 2000)).withColumn("forecast_id", F.concat(F.lit("again"), "forecast_id")))
    r = r.unionByName(r.where(f"series_id = '{PROXY}' AND period = 'validation'")).where("NOT (series_id = 'N' AND period = 'validation')")
    t = t.where("series_id <> 'A'").unionByName(t.where("series_id = 'N'")).unionByName(t.where("series_id = 'R'").withColumn("fit_id", F.lit("other")))
    return runner.artifact_faults(runner.Artifacts(w, r, f, t))


def every_reconciliation_fault(spark, d):
    """Every fault of the evaluation tables, planted in places of its own."""
    rows = _joined(spark, d).cache()
    variance, quantile = evaluation.variance_observations(rows), evaluation.quantile_observations(rows)
    pairs = evaluation.point_estimates(evaluation.all_pairs(variance, quantile)).withColumns({"experiment_id": F.lit(_name()), "observation_count": F.col("paired_count")})
    more = lambda column, place: F.when(F.expr(place), F.col(column) + 1).otherwise(F.col(column))
    place = lambda series, period, model=models.EWMA: f"series_id = '{series}' AND period = '{period}' AND model_id = '{model}'"
    pairs = pairs.withColumn("paired_count", more("paired_count", place("R", "test"))).withColumn("observation_count", more("observation_count", f"{place('R', 'test')} OR {place('R', 'validation')}"))
    tables = {
        "forecast_availability": evaluation.availability(rows, _name()).withColumn("value", more("value", f"metric = 'failed_forecast_count' AND {place('A', 'validation')}")),
        "variance_scores": evaluation.score_table(variance, _name()).withColumn("observation_count", more("observation_count", place("N", "validation", models.HISTORICAL_VARIANCE))),
        "quantile_scores": evaluation.score_table(quantile, _name(), ("confidence_level", "tail_probability")),
        "coverage_tests": evaluation.coverage_table(quantile, _name()).withColumn("observation_count", more("observation_count", place(PROXY, "test", models.HISTORICAL_SIMULATION))),
        "bootstrap_comparisons": pairs.withColumn("period", F.when(F.expr(place("N", "test")), "development").otherwise(F.col("period"))),
        "period_breakdowns": evaluation.breakdowns(rows, variance, quantile, PROFILE).withColumn("period", F.regexp_replace("period", "test_2001", "test_2002")),
    }
    return reporting.reconciliation(tables, evaluation.test_years(PROFILE))


QUERIES = {
    "supplier_panel": supplier_panel,
    "supplier_variance_scores": supplier_variance_scores,
    "supplier_quantile_scores": supplier_quantile_scores,
    "supplier_exception_counts": supplier_exception_counts,
    "supplier_point_estimates": supplier_point_estimates,
    "supplier_directions": supplier_directions,
    "supplier_stored_forecasts": supplier_stored_forecasts,
    "supplier_pixels": supplier_pixels,
    "every_artifact_fault": every_artifact_fault,
    "every_reconciliation_fault": every_reconciliation_fault,
    "panel_returns": panel_returns,
    "proxy_series": proxy_series,
    "index_faults": index_faults,
    "trailing_windows": trailing_windows,
    "expanding_windows": expanding_windows,
    "refit_windows": refit_windows,
    "realizations": realizations,
    "hist_variance_path": hist_variance_path,
    "hist_sim_path": _simulation("linear"),
    "hist_sim_path_lower": _simulation("lower"),
    "hist_sim_path_higher": _simulation("higher"),
    "hist_sim_path_midpoint": _simulation("midpoint"),
    "hist_sim_path_nearest": _simulation("nearest"),
    "ewma_path": ewma_path,
    "garch_filter_path": garch_filter_path,
    "forecast_union": forecast_union,
    "forecast_ids": forecast_ids,
    "ewma_diagnostics": ewma_diagnostics,
    "availability": availability,
    "variance_scores": variance_scores,
    "quantile_scores": quantile_scores,
    "exception_counts": exception_counts,
    "coverage_statistics": coverage_statistics,
    "coverage_tests": coverage_tests,
    "paired_differences": paired_differences,
    "bootstrap_point_estimates": bootstrap_point_estimates,
    "bootstrap_intervals": bootstrap_intervals,
    "period_breakdowns": period_breakdowns,
    "rolling_advantage": rolling_advantage,
    "realized_rms": realized_rms,
    "availability_pivot": availability_pivot,
    "coverage_pivot": coverage_pivot,
    "calibration_points": calibration_points,
    "calibration_summary": calibration_summary,
    "volatility_history": volatility_history,
    "exception_history": exception_history,
    "period_context": period_context,
    "reconcile_counts": reconcile_counts,
    "variance_guard": variance_guard,
    "availability_with_garch": availability_with_garch,
    "variance_scores_with_garch": variance_scores_with_garch,
    "quantile_scores_with_garch": quantile_scores_with_garch,
    "coverage_tests_with_garch": coverage_tests_with_garch,
    "paired_differences_with_garch": paired_differences_with_garch,
    "bootstrap_point_estimates_with_garch": bootstrap_point_estimates_with_garch,
    "period_breakdowns_with_garch": period_breakdowns_with_garch,
    "comparison_rows": comparison_rows,
    "candidate_directions": candidate_directions,
    "diagnostics_summary": diagnostics_summary,
    "artifact_faults": artifact_faults,
    "parameter_checks": parameter_checks,
    "garch_fits": garch_fits,
    "garch_forecasts": garch_forecasts,
    "garch_stored_forecasts": garch_stored_forecasts,
    "garch_stored_likelihoods": garch_stored_likelihoods,
    "student_t_quantiles": quantiles_of_t,
    "synthetic_fixture": synthetic_fixture,
    "score_functions": variance_gauntlet,
    "canonical_ids": canonical_ids,
}


# -- SQL ----------------------------------------------------------------------------------

_WIDE = " + ".join([f"0.0::DOUBLE + {WEIGHTS['A']}::DOUBLE * max(r) FILTER (series_id = 'A')", *[f"{WEIGHTS[k]}::DOUBLE * max(r) FILTER (series_id = '{k}')" for k in ("N", "R")]])
_CTE: dict[str, str] = {}
_CTE["daily"] = "SELECT l_returnflag AS series_id, l_shipdate::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) AS level FROM lineitem GROUP BY 1, 2"
_CTE["aligned"] = "SELECT *, count(*) OVER (PARTITION BY date) AS n FROM daily"
_CTE["inst"] = "SELECT * FROM (SELECT series_id, date, level / lag(level) OVER (PARTITION BY series_id ORDER BY date) - 1 AS r FROM aligned WHERE n = 3) WHERE r IS NOT NULL"
_CTE["wide"] = f"SELECT date, max(r) FILTER (series_id = 'A') AS \"A\", max(r) FILTER (series_id = 'N') AS \"N\", max(r) FILTER (series_id = 'R') AS \"R\", {_WIDE} AS \"{PROXY}\" FROM inst GROUP BY date"
_CTE["panel"] = f"SELECT series_id, date, (row_number() OVER (PARTITION BY series_id ORDER BY date) - 1)::INTEGER AS pos, r FROM (SELECT series_id, date, r FROM inst UNION ALL SELECT '{PROXY}', date, \"{PROXY}\" FROM wide)"
_PERIOD = "CASE " + " ".join(f"WHEN target_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in P.ranges()) + " END"
_CTE["grid"] = f"SELECT *, {_PERIOD} AS period FROM (SELECT series_id, pos, r, date AS forecast_origin, lead(date) OVER w AS target_date, lead(r) OVER w AS next_r, first_value(date) OVER w AS first_date, lag(date, {H.variance_window - 1}) OVER w AS start_60, lag(date, {H.var_window - 1}) OVER w AS start_100 FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY date))"
_CTE["eligible"] = "SELECT * FROM grid WHERE period IS NOT NULL"
_CTE["real"] = f"SELECT series_id, forecast_origin, target_date, next_r AS simple_return, next_r * next_r AS squared_return, -next_r AS loss, period FROM eligible WHERE pos >= {min(H.variance_window, H.var_window) - 1}"
_CTE["hv"] = f"SELECT series_id, pos, var_samp(r) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {H.variance_window - 1} PRECEDING AND CURRENT ROW) AS variance FROM panel QUALIFY pos >= {H.variance_window - 1}"
_FRAME = f"OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {H.var_window - 1} PRECEDING AND CURRENT ROW)"
_CTE["hs"] = f"SELECT series_id, pos, quantile_cont(r, 0.05) {_FRAME} AS q05, quantile_cont(r, 0.01) {_FRAME} AS q01 FROM panel QUALIFY pos >= {H.var_window - 1}"
_E = PROFILE.ewma
_CTE["ew"] = (
    f"SELECT series_id, {_E.initialization_window - 1} AS pos, var_samp(r) AS variance FROM panel WHERE pos < {_E.initialization_window} GROUP BY series_id HAVING count(*) = {_E.initialization_window} "
    f"UNION ALL SELECT p.series_id, p.pos, {_E.lambda_}::DOUBLE * e.variance + (1 - {_E.lambda_}::DOUBLE) * (p.r * p.r) FROM ew e JOIN panel p ON p.series_id = e.series_id AND p.pos = e.pos + 1"
)
_NULLS = ", ".join(["NULL::DOUBLE"] * 4)
_LOSS = "CASE WHEN {0} IS NULL THEN NULL ELSE greatest(0.0, -{0}) END"
_CTE["forecasts"] = f"""
  SELECT g.series_id, '{models.HISTORICAL_VARIANCE}' AS model_id, forecast_origin, target_date, start_60 AS train_start, variance, sqrt(variance) AS volatility,
    NULL::DOUBLE AS return_quantile_0_05, NULL::DOUBLE AS var_0_95, NULL::DOUBLE AS return_quantile_0_01, NULL::DOUBLE AS var_0_99 FROM eligible g JOIN hv ON g.series_id = hv.series_id AND g.pos = hv.pos
  UNION ALL SELECT g.series_id, '{models.HISTORICAL_SIMULATION}', forecast_origin, target_date, start_100, NULL, NULL, q05, greatest(0.0, -q05), q01, greatest(0.0, -q01) FROM eligible g JOIN hs ON g.series_id = hs.series_id AND g.pos = hs.pos
  UNION ALL SELECT g.series_id, '{models.EWMA}', forecast_origin, target_date, first_date, variance, sqrt(variance), sqrt(variance) * {Z_05}::DOUBLE, greatest(0.0, -(sqrt(variance) * {Z_05}::DOUBLE)),
    sqrt(variance) * {Z_01}::DOUBLE, greatest(0.0, -(sqrt(variance) * {Z_01}::DOUBLE)) FROM eligible g JOIN ew ON g.series_id = ew.series_id AND g.pos = ew.pos"""
_CTE["joined"] = "SELECT f.*, r.simple_return, r.squared_return, r.loss, r.period, CASE WHEN f.variance IS NULL AND f.return_quantile_0_05 IS NULL THEN 'failed' ELSE 'ok' END AS status FROM forecasts f JOIN real r ON f.series_id = r.series_id AND f.forecast_origin = r.forecast_origin AND f.target_date = r.target_date WHERE r.period IN ('validation', 'test')"
_CTE["vobs"] = """SELECT period, model_id, series_id, forecast_origin, target_date, unnest(['qlike', 'squared_error', 'absolute_error']) AS metric,
  unnest([ln(variance) + squared_return / variance, (squared_return - variance) * (squared_return - variance), abs(squared_return - variance)]) AS score FROM joined WHERE variance IS NOT NULL"""
_CTE["qobs"] = """SELECT period, model_id, series_id, forecast_origin, target_date, 'pinball_loss_0_05' AS metric, 0.95::DOUBLE AS confidence_level, 0.05::DOUBLE AS tail_probability,
    (0.05::DOUBLE - CASE WHEN simple_return < return_quantile_0_05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * (simple_return - return_quantile_0_05) AS score, loss > var_0_95 AS exception FROM joined WHERE var_0_95 IS NOT NULL
  UNION ALL SELECT period, model_id, series_id, forecast_origin, target_date, 'pinball_loss_0_01', 0.99::DOUBLE, 0.01::DOUBLE,
    (0.01::DOUBLE - CASE WHEN simple_return < return_quantile_0_01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * (simple_return - return_quantile_0_01), loss > var_0_99 FROM joined WHERE var_0_99 IS NOT NULL"""
_G = "period, series_id, model_id, confidence_level, tail_probability"
_CTE["steps"] = f"SELECT *, exception::INTEGER AS now, lag(exception::INTEGER) OVER w AS before, sum(1 - exception::INTEGER) OVER w AS island FROM qobs WINDOW w AS (PARTITION BY {_G} ORDER BY target_date)"
_CTE["runs"] = f"SELECT *, sum(now) OVER (PARTITION BY {_G}, island) AS run FROM steps"
_CTE["counts"] = f"SELECT {_G}, count(*)::BIGINT AS observation_count, sum(now)::BIGINT AS exception_count, " + ", ".join(f"count(*) FILTER (before = {a} AND now = {b})::BIGINT AS n{a}{b}" for a in (0, 1) for b in (0, 1)) + f", max(run)::BIGINT AS longest_exception_cluster FROM runs GROUP BY {_G}"


def _ll(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN ({k}) = 0 THEN 0.0::DOUBLE ELSE ({k}) * ln({p}) END + CASE WHEN ({n}) = ({k}) THEN 0.0::DOUBLE ELSE (({n}) - ({k})) * ln(1 - ({p})) END)"


_X, _N = "exception_count::DOUBLE", "observation_count::DOUBLE"
_T, _EV = "(n00 + n01 + n10 + n11)::DOUBLE", "(n01 + n11)::DOUBLE"
_ENOUGH = "n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0"
_CTE["cover"] = (
    f"SELECT *, {_X} / {_N} AS exception_rate, greatest(0.0, -2.0 * ({_ll(_X, _N, 'tail_probability')} - {_ll(_X, _N, f'{_X} / {_N}')})) AS kupiec_lr, "
    f"CASE WHEN {_ENOUGH} THEN greatest(0.0, -2.0 * ({_ll(_EV, _T, f'{_EV} / {_T}')} - ({_ll('n01::DOUBLE', '(n00 + n01)::DOUBLE', 'n01::DOUBLE / (n00 + n01)')} + {_ll('n11::DOUBLE', '(n10 + n11)::DOUBLE', 'n11::DOUBLE / (n10 + n11)')}))) END AS christoffersen_independence_lr, "
    f"CASE WHEN {_ENOUGH} THEN 'ok' ELSE 'insufficient_events' END AS christoffersen_status FROM counts"
)
_CTE["pairs"] = "\n  UNION ALL ".join(
    f"SELECT c.period, c.model_id, '{b}' AS benchmark_model_id, c.metric, c.series_id, c.forecast_origin, c.target_date, c.score - b.score AS difference FROM {t} c JOIN {t} b ON c.period = b.period AND c.metric = b.metric AND c.series_id = b.series_id AND c.forecast_origin = b.forecast_origin AND c.target_date = b.target_date AND b.model_id = '{b}' WHERE c.model_id IN {models.CANDIDATES}"
    for t, b in (("vobs", models.HISTORICAL_VARIANCE), ("qobs", models.HISTORICAL_SIMULATION))
)
_CTE["avail"] = """SELECT period, series_id, model_id, unnest(['total_eligible_target_dates', 'valid_forecast_count', 'failed_forecast_count', 'unavailable_forecast_count']) AS metric, n AS observation_count,
  unnest([n::DOUBLE, ok::DOUBLE, (n - ok)::DOUBLE, 0.0::DOUBLE]) AS value FROM (SELECT period, coalesce(series_id, 'ALL') AS series_id, model_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM joined GROUP BY GROUPING SETS ((period, series_id, model_id), (period, model_id)))"""
_SETS = "GROUP BY GROUPING SETS ((period, series_id, model_id, metric{0}), (period, model_id, metric{0}))"


def _sql(*parts: str) -> str:
    """The last part as a query over the tables before it (all of them, in order)."""
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in _CTE.items()) + "\n" + parts[-1]


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names)


def _nearest(method: str) -> str:
    import math

    sides = []
    for name, p in (("q05", 0.05), ("q01", 0.01)):
        h = p * (H.var_window - 1)
        at = {"lower": [math.floor(h)], "higher": [math.ceil(h)], "midpoint": [math.floor(h), math.ceil(h)], "nearest": [round(h)]}[method]
        sides.append("(" + " + ".join(f"s[{i + 1}]" for i in at) + f") / {len(at)} AS {name}")
    inner = f"SELECT series_id, pos, {', '.join(sides)} FROM (SELECT series_id, pos, list_sort(list(r) {_FRAME}) AS s FROM panel) WHERE pos >= {H.var_window - 1}"
    return _sql(f"SELECT series_id, pos, round(q05, 9) AS return_quantile_0_05, round(q01, 9) AS return_quantile_0_01, round(greatest(0.0, -q05), 9) AS var_0_95, round(greatest(0.0, -q01), 9) AS var_0_99 FROM ({inner})")


def _window_sql(model: str, least: int, start: str, count: str, refit: str = "false") -> str:
    return f"SELECT series_id, {model} AS model_id, forecast_origin, target_date, {start} AS train_start, forecast_origin AS train_end, ({count})::BIGINT AS train_observation_count, period, {refit} AS scheduled_refit FROM eligible WHERE pos >= {least - 1}"


def _normal_path(source: str) -> str:
    sd = "sqrt(variance)"
    q = {"return_quantile_0_05": f"{sd} * {Z_05}::DOUBLE", "return_quantile_0_01": f"{sd} * {Z_01}::DOUBLE"}
    cols = [f"round({v}, 9) AS {k}" for k, v in q.items()] + [f"round(greatest(0.0, -({q[a]})), 9) AS {b}" for a, b in (("return_quantile_0_05", "var_0_95"), ("return_quantile_0_01", "var_0_99"))]
    return f"SELECT series_id, pos::INTEGER AS pos, round(variance, 9) AS variance, round({sd}, 9) AS volatility, {', '.join(cols)} FROM {source}"


def _json(fields: dict[str, str]) -> str:
    """Canonical JSON of text columns, keys in order."""
    body = " || ',' || ".join(f"'\"{k}\":\"' || {fields[k]} || '\"'" for k in sorted(fields))
    return f"'{{' || {body} || '}}'"


def _id(prefix: str, fields: dict[str, str]) -> str:
    return f"'{prefix}' || substring(sha256({_json(fields)}), 1, 24)"


_DAY = "strftime({}, '%Y-%m-%d') || 'T00:00:00'"
_FIT = {
    "experiment_id": f"'{_name()}'", "series_id": "series_id", "model_id": "model_id", "fit_origin": _DAY.format("fit_origin"), "train_start": _DAY.format("fit_start"), "train_end": _DAY.format("fit_origin"),
    "upstream_simple_return_checksum": f"'{CHECKSUM}'", "forecasting_package_version": f"'{runner.__version__}'",
}
_FORECAST = {"experiment_id": f"'{_name()}'", "fit_id": "fit_id", "series_id": "series_id", "model_id": "model_id", "forecast_origin": _DAY.format("forecast_origin"), "target_date": _DAY.format("target_date")}
_DATED = f"SELECT *, CASE WHEN model_id = '{models.EWMA}' THEN min(forecast_origin) OVER (PARTITION BY series_id, model_id) ELSE forecast_origin END AS fit_origin, train_start AS fit_start FROM forecasts"
_VALUES = ("variance", "volatility", "return_quantile_0_05", "var_0_95", "return_quantile_0_01", "var_0_99")
_g = PROFILE.garch
_LONG = {
    "expected_exception_probability": "tail_probability", "exception_count": "exception_count", "exception_rate": "exception_rate", "longest_exception_cluster": "longest_exception_cluster", "n00": "n00", "n01": "n01", "n10": "n10", "n11": "n11", "kupiec_lr": "kupiec_lr",
}
def _tail(lr: str) -> str:
    """P(chi-square with one degree of freedom > lr), from a series for the error function."""
    x = f"sqrt(({lr}) / 2)"
    term = f"{x} * exp(k * ln(({lr})::DOUBLE) - ((k + 1) * ln(2::DOUBLE) + lgamma(k + 1.5::DOUBLE) - 0.5 * ln(pi())))"
    series = f"2 / sqrt(pi()) * exp(-({lr}) / 2) * list_sum(list_transform(range(0, 600), lambda k: {term}))"
    return f"CASE WHEN ({lr}) IS NULL THEN NULL WHEN ({lr}) <= 0 THEN 1.0::DOUBLE WHEN ({lr}) > 150 THEN 0.0::DOUBLE ELSE 1 - {series} END"


_LONG |= {
    "kupiec_p_value": _tail("kupiec_lr"),
    "christoffersen_independence_lr": "christoffersen_independence_lr",
    "christoffersen_independence_p_value": _tail("christoffersen_independence_lr"),
    "conditional_coverage_lr": "kupiec_lr + christoffersen_independence_lr",
    "conditional_coverage_p_value": "exp(-(kupiec_lr + christoffersen_independence_lr) / 2)",
}
_CTE["tests"] = f"""SELECT '{_name()}' AS experiment_id, period, series_id, model_id, unnest([{", ".join(repr(k) for k in _LONG)}]) AS metric, observation_count,
  unnest([{", ".join(f"({v})::DOUBLE" for v in _LONG.values())}]) AS value, confidence_level, tail_probability,
  unnest([{", ".join("christoffersen_status" if k.startswith(("christoffersen", "conditional")) else "'ok'" for k in _LONG)}]) AS status FROM cover"""
_YEARS = "period = 'test' AND year(target_date) BETWEEN 1999 AND 2001"


def _yearly(source: str, value: str, metric: str) -> str:
    return f"SELECT year(target_date) AS y, coalesce(series_id, 'ALL') AS series_id, model_id, {metric} AS metric, count(*) AS n, avg({value}) AS v FROM {source} WHERE {_YEARS} GROUP BY GROUPING SETS ((y, series_id, model_id, metric), (y, model_id, metric))"


def _yearly_counts() -> str:
    inner = f"SELECT year(target_date) AS y, coalesce(series_id, 'ALL') AS series_id, model_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM joined WHERE {_YEARS} GROUP BY GROUPING SETS ((y, series_id, model_id), (y, model_id))"
    return f"SELECT y, series_id, model_id, unnest(['valid_forecast_count', 'failed_forecast_count', 'unavailable_forecast_count']) AS metric, n, unnest([ok::DOUBLE, (n - ok)::DOUBLE, 0.0::DOUBLE]) AS v FROM ({inner})"


_GARCH_PATH = f"""(WITH RECURSIVE gf AS (SELECT series_id, 59 AS pos, var_samp(r * 100.0::DOUBLE) AS v FROM panel WHERE pos < 60 GROUP BY series_id HAVING count(*) = 60
  UNION ALL SELECT p.series_id, p.pos, {GARCH["omega"]}::DOUBLE + {GARCH["alpha"]}::DOUBLE * ((p.r * 100.0::DOUBLE) * (p.r * 100.0::DOUBLE)) + {GARCH["beta"]}::DOUBLE * g.v FROM gf g JOIN panel p ON p.series_id = g.series_id AND p.pos = g.pos + 1)
  SELECT series_id, pos, v / 10000.0::DOUBLE AS variance FROM gf)"""

SQL = {
    "panel_returns": _sql(f"SELECT series_id, (CASE series_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS series_pos, date, pos, round(r, 9) AS simple_return FROM panel WHERE series_id <> '{PROXY}'"),
    "proxy_series": _sql(f'SELECT date, round("A", 9) AS "A", round("N", 9) AS "N", round("R", 9) AS "R", round("{PROXY}", 9) AS "{PROXY}" FROM wide'),
    "index_faults": "WITH d AS (SELECT o_orderkey AS pos, o_orderdate::DATE AS date FROM orders) SELECT 'duplicate' AS fault, date FROM d GROUP BY date HAVING count(*) > 1 UNION ALL SELECT 'unsorted', date FROM (SELECT date, lag(date) OVER (ORDER BY pos) AS b FROM d) WHERE date < b",
    "trailing_windows": _sql(_window_sql(f"'{models.HISTORICAL_VARIANCE}'", H.variance_window, "start_60", str(H.variance_window))),
    "expanding_windows": _sql(_window_sql(f"'{models.EWMA}'", _E.initialization_window, "first_date", "pos + 1")),
    "refit_windows": _sql(f"SELECT w.* REPLACE (m.id AS model_id) FROM ({_window_sql(repr('x'), _g.estimation_window, 'start_100', str(_g.estimation_window), f'(row_number() OVER (PARTITION BY series_id ORDER BY forecast_origin) - 1) % {_g.refit_every_origins} = 0')}) w, (SELECT unnest(['{models.GARCH_GAUSSIAN}', '{models.GARCH_STUDENT_T}']) AS id) m"),
    "realizations": _sql(f"SELECT series_id, forecast_origin, target_date, {_r('simple_return', 'squared_return', 'loss')}, period FROM real"),
    "hist_variance_path": _sql("SELECT series_id, pos, round(variance, 9) AS variance, round(sqrt(variance), 9) AS volatility FROM hv"),
    "hist_sim_path": _sql("SELECT series_id, pos, round(q05, 9) AS return_quantile_0_05, round(q01, 9) AS return_quantile_0_01, round(greatest(0.0, -q05), 9) AS var_0_95, round(greatest(0.0, -q01), 9) AS var_0_99 FROM hs"),
    **{f"hist_sim_path_{k}": _nearest(k) for k in ("lower", "higher", "midpoint", "nearest")},
    "ewma_path": _sql(_normal_path("ew")),
    "garch_filter_path": _sql(_normal_path(_GARCH_PATH)),
    "forecast_union": _sql(f"SELECT '{_name()}' AS experiment_id, series_id, model_id, '{runner.__version__}' AS model_version, forecast_origin, target_date, {_r(*_VALUES)}, 'ok' AS status, NULL::VARCHAR AS error_code, '[]' AS warning_codes FROM forecasts"),
    "forecast_ids": _sql(f"SELECT series_id, model_id, forecast_origin, fit_id, {_id('fcst_', _FORECAST)} AS forecast_id FROM (SELECT *, {_id('fit_', _FIT)} AS fit_id FROM ({_DATED}))"),
    "ewma_diagnostics": _sql(
        f"SELECT DISTINCT {_id('fit_', _FIT)} AS fit_id, series_id, model_id, fit_origin, fit_start AS train_start, fit_origin AS train_end, {_E.initialization_window}::BIGINT AS observation_count, NULL::DOUBLE AS omega, NULL::DOUBLE AS alpha, NULL::DOUBLE AS beta, NULL::DOUBLE AS degrees_of_freedom, {_E.lambda_}::DOUBLE AS parameter_persistence, true AS converged, 'not_applicable_recursive_model' AS optimizer_status, false AS retry_used, 0.0::DOUBLE AS runtime_seconds, 1.0::DOUBLE AS scaling_factor, '[]' AS warning_codes FROM ({_DATED}) WHERE model_id = '{models.EWMA}'"
    ),
    "availability": _sql(f"SELECT '{_name()}' AS experiment_id, period, series_id, model_id, metric, observation_count, value FROM avail"),
    "variance_scores": _sql(f"SELECT '{_name()}' AS experiment_id, period, coalesce(series_id, 'ALL') AS series_id, model_id, metric, count(*) AS observation_count, round(avg(score), 9) AS value FROM vobs {_SETS.format('')}"),
    "quantile_scores": _sql(f"SELECT '{_name()}' AS experiment_id, period, coalesce(series_id, 'ALL') AS series_id, model_id, metric, count(*) AS observation_count, round(avg(score), 9) AS value, confidence_level, tail_probability FROM qobs {_SETS.format(', confidence_level, tail_probability')}"),
    "exception_counts": _sql("SELECT * FROM counts"),
    "coverage_statistics": _sql(f"SELECT {_G}, {_r('exception_rate', 'kupiec_lr', 'christoffersen_independence_lr')}, round(kupiec_lr + christoffersen_independence_lr, 9) AS conditional_coverage_lr, round(exp(-(kupiec_lr + christoffersen_independence_lr) / 2), 9) AS conditional_coverage_p_value, christoffersen_status FROM cover"),
    "coverage_tests": _sql("SELECT * REPLACE (round(value, 9) AS value) FROM tests"),
    "coverage_pivot": _sql("SELECT series_id, model_id, " + ", ".join(f"round(max(value) FILTER (metric = '{k}'), 9) AS {k}" for k in reporting.COVERAGE_COLUMNS) + " FROM tests WHERE period = 'test' AND confidence_level = 0.95 GROUP BY series_id, model_id"),
    "calibration_summary": _sql("SELECT model_id, count(value) AS valid_tests, count(*) FILTER (value < 0.05) AS rejections, CASE WHEN count(*) FILTER (value < 0.05) > 0 THEN 'rejected' WHEN count(value) = 8 THEN 'consistent' ELSE 'incomplete' END AS verdict FROM tests WHERE period = 'test' AND metric = 'kupiec_p_value' GROUP BY model_id"),
    "paired_differences": _sql("SELECT period, model_id, benchmark_model_id, metric, series_id, forecast_origin, target_date, round(difference, 9) AS difference FROM pairs"),
    "bootstrap_point_estimates": _sql(
        "SELECT coalesce(series_id, 'ALL') AS series_id, period, model_id, benchmark_model_id, metric, count(*) AS paired_count, round(avg(difference), 9) AS value, round(median(difference), 9) AS median_difference, CASE WHEN avg(difference) < 0 THEN 'candidate_better' WHEN avg(difference) > 0 THEN 'benchmark_better' ELSE 'tie' END AS effect_direction FROM pairs GROUP BY GROUPING SETS ((period, series_id, model_id, benchmark_model_id, metric), (period, model_id, benchmark_model_id, metric))"
    ),
    "period_breakdowns": _sql(
        f"SELECT '{_name()}' AS experiment_id, 'test_' || y AS period, series_id, model_id, metric, n AS observation_count, round(v, 9) AS value, y || '-01-01' AS period_start, y || '-12-31' AS period_end FROM ({_yearly_counts()} UNION ALL {_yearly('vobs', 'score', 'metric')} UNION ALL {_yearly('qobs', 'score', 'metric')} UNION ALL SELECT y, series_id, model_id, replace(metric, 'pinball_loss', 'exception_rate'), n, v FROM ({_yearly('qobs', 'exception::INTEGER', 'metric')}))"
    ),
    "rolling_advantage": _sql(
        """, q AS (SELECT * FROM pairs WHERE metric = 'qlike'), dd AS (SELECT model_id, metric, target_date, avg(difference) AS difference FROM q GROUP BY ALL HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM q)),
cal AS (SELECT * FROM (SELECT DISTINCT target_date FROM q), (SELECT DISTINCT model_id, metric FROM q))
SELECT model_id, metric, target_date, round(CASE WHEN count(difference) OVER w = 20 THEN avg(difference) OVER w END, 9) AS rolling_difference FROM cal LEFT JOIN dd USING (model_id, metric, target_date) WINDOW w AS (PARTITION BY model_id, metric ORDER BY target_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
    ),
    "realized_rms": _sql("SELECT series_id, target_date, round(abs(simple_return) * 100, 9) AS absolute_return, round(CASE WHEN count(squared_return) OVER w >= 5 THEN sqrt(avg(squared_return) OVER w) * 100 END, 9) AS rolling_rms FROM real WINDOW w AS (PARTITION BY series_id ORDER BY target_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"),
    "availability_pivot": _sql("SELECT model_id, max(value) FILTER (metric = 'total_eligible_target_dates') AS total_eligible_target_dates, max(value) FILTER (metric = 'valid_forecast_count') AS valid_forecast_count, max(value) FILTER (metric = 'failed_forecast_count') AS failed_forecast_count, max(value) FILTER (metric = 'unavailable_forecast_count') AS unavailable_forecast_count, round(max(value) FILTER (metric = 'valid_forecast_count') / max(value) FILTER (metric = 'total_eligible_target_dates'), 9) AS valid_share FROM avail WHERE period = 'test' AND series_id = 'ALL' GROUP BY model_id"),
    "calibration_points": _sql("SELECT series_id, model_id, confidence_level, tail_probability AS nominal_rate, round(exception_rate, 9) AS exception_rate FROM cover WHERE period = 'test'"),
    "volatility_history": _sql(
        f", rms AS (SELECT series_id, target_date, abs(simple_return) * 100 AS absolute_return, CASE WHEN count(squared_return) OVER w >= 5 THEN sqrt(avg(squared_return) OVER w) * 100 END AS rolling_rms FROM real WINDOW w AS (PARTITION BY series_id ORDER BY target_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT f.series_id, model_id, f.target_date, round(sqrt(variance) * 100, 9) AS volatility, {_r('absolute_return', 'rolling_rms')} FROM forecasts f JOIN rms ON f.series_id = rms.series_id AND f.target_date = rms.target_date WHERE variance > 0"
    ),
    "exception_history": _sql("SELECT f.series_id, f.forecast_origin, f.target_date, model_id, round(var_0_95, 9) AS var_0_95, round(loss, 9) AS loss FROM forecasts f JOIN real r ON f.series_id = r.series_id AND f.forecast_origin = r.forecast_origin AND f.target_date = r.target_date WHERE loss > var_0_95"),
    "period_context": _sql("SELECT period, min(target_date) AS first_date, max(target_date) AS last_date FROM real GROUP BY period"),
    "synthetic_fixture": """WITH days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT unnest(generate_series(DATE '2007-01-02', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS date) WHERE isodow(date) < 6),
keyed AS (SELECT o_orderkey::BIGINT AS o_orderkey FROM orders),
placed AS (SELECT o_orderkey, date, o_orderkey AS p FROM keyed LEFT JOIN days ON p = o_orderkey % (SELECT count(*) FROM days)
  UNION ALL SELECT NULL, date, p FROM days WHERE p NOT IN (SELECT o_orderkey FROM keyed WHERE o_orderkey IS NOT NULL))
SELECT o_orderkey, date, round((p % 17 - 8) / 1000.0::DOUBLE, 9) AS "SPY", round((p * 3 % 19 - 9) / 2000.0::DOUBLE, 9) AS "IEF", round((p * 5 % 23 - 11) / 1500.0::DOUBLE, 9) AS "GLD" FROM placed""",
    "score_functions": _sql("SELECT series_id, pos, round(ln(0.04::DOUBLE) + r * r / 0.04::DOUBLE, 9) AS qlike, round((0.05::DOUBLE - CASE WHEN r < -0.03::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * (r - -0.03::DOUBLE), 9) AS pinball, -r > 0.03::DOUBLE AS exception FROM panel"),
    "canonical_ids": f"SELECT n_name, {_id('x_', {'name': 'n_name', 'day': _DAY.format('day')})} AS id FROM (SELECT n_name, DATE '2020-01-01' + n_nationkey::INTEGER AS day FROM nation)",
}
SQL["reconcile_counts"] = f"""SELECT * FROM (
  SELECT 'scores do not match valid forecasts' AS fault, count(*) AS n FROM ({SQL["quantile_scores"]}) q WHERE {TAMPERED}
  UNION ALL SELECT 'coverage does not match scores', count(*) FROM ({SQL["coverage_tests"]}) c WHERE {TAMPERED}) WHERE n > 0"""

_FAILS = "pos % 7 = 0 OR pos % 11 = 0"
_SD = "sqrt(variance)"
_FILTERED = f"""SELECT g.series_id, g.pos, forecast_origin, target_date, start_60, CASE WHEN NOT (g.pos % 7 = 0 OR g.pos % 11 = 0) THEN variance END AS variance
  FROM eligible g JOIN gpath ON g.series_id = gpath.series_id AND g.pos = gpath.pos"""
_MORE = f"""{_CTE["forecasts"]}
  UNION ALL SELECT series_id, '{models.GARCH_GAUSSIAN}', forecast_origin, target_date, start_60, variance, {_SD}, {_SD} * {Z_05}::DOUBLE, {_LOSS.format(f"({_SD} * {Z_05}::DOUBLE)")}, {_SD} * {Z_01}::DOUBLE, {_LOSS.format(f"({_SD} * {Z_01}::DOUBLE)")} FROM filtered"""


def _with_garch(sql: str) -> str:
    """The same query where the forecasts also hold the recursion at fixed parameters."""
    return sql.replace(f"forecasts AS ({_CTE['forecasts']})", f"gpath AS (SELECT * FROM {_GARCH_PATH}),\nfiltered AS ({_FILTERED}),\nforecasts AS ({_MORE})")


SQL |= {f"{k}_with_garch": _with_garch(SQL[k]) for k in ("availability", "variance_scores", "quantile_scores", "coverage_tests", "paired_differences", "bootstrap_point_estimates", "period_breakdowns")}
SQL["variance_guard"] = _with_garch(_sql(
    f"SELECT series_id, forecast_origin, round(variance, 9) AS variance, round({_LOSS.format(f'({_SD} * {Z_05}::DOUBLE)')}, 9) AS var_0_95, CASE WHEN {_FAILS} THEN 'failed' ELSE 'ok' END AS status, "
    "CASE WHEN pos % 7 = 0 THEN 'NONPOSITIVE_VARIANCE' WHEN pos % 11 = 0 THEN 'NONFINITE_VARIANCE' END AS error_code FROM filtered"
))
SQL["comparison_rows"] = f"SELECT * FROM ({SQL['bootstrap_point_estimates_with_garch']}) WHERE period = 'test' AND series_id = 'ALL' AND metric = 'qlike'"
SQL["candidate_directions"] = _with_garch(_sql("SELECT period, metric, model_id FROM pairs WHERE metric IN ('qlike', 'pinball_loss_0_05') GROUP BY ALL HAVING avg(difference) < 0 AND avg(difference) + 1.96 * stddev_samp(difference) / sqrt(count(*)) < 0"))
SQL["diagnostics_summary"] = _sql(f"SELECT '{models.EWMA}' AS model_id, count(DISTINCT series_id) AS fits, count(DISTINCT series_id) AS converged, 0::BIGINT AS retries, 0::BIGINT AS failed_forecasts FROM forecasts WHERE model_id = '{models.EWMA}'")
SQL["artifact_faults"] = _sql(
    f"""SELECT * FROM (SELECT 'a forecast has no realization' AS fault, count(*) AS n FROM forecasts JOIN real USING (series_id, forecast_origin, target_date) WHERE {LACKING}
  UNION ALL SELECT 'a candidate''s fit has no diagnostics', count(DISTINCT series_id) FROM forecasts WHERE model_id = '{models.EWMA}') WHERE n > 0"""
)
SQL["parameter_checks"] = """SELECT s_suppkey, CASE WHEN omega <= 0 OR (student AND df IS NULL) THEN 'MODEL_FIT_FAILED' WHEN alpha + beta >= 1 - 1e-8 THEN 'NONSTATIONARY_PARAMETERS'
  WHEN student AND df <= 2 OR NOT student AND df IS NOT NULL THEN 'INVALID_STUDENT_T_DOF' ELSE 'ok' END AS code
FROM (SELECT s_suppkey::BIGINT AS s_suppkey, (s_suppkey % 5) / 10.0::DOUBLE AS omega, (s_suppkey % 4) / 5.0::DOUBLE AS alpha, (s_suppkey % 7) / 8.0::DOUBLE AS beta, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 6)::DOUBLE END AS df, s_suppkey % 2 = 0 AS student FROM supplier)"""

_W, _S = _g.estimation_window, PROFILE.garch.input_scale
_NEXT = f"{STORED.omega}::DOUBLE + {STORED.alpha}::DOUBLE * {{0}} + {STORED.beta}::DOUBLE * {{1}}"
#: Origins numbered by series, the fit of each, its window's squares (j from 0) with those of the
#: later origins of its block behind them, the variance before its first return, and the path.
_CHAIN = f"""nth AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS nr FROM eligible WHERE pos >= {_W - 1}),
fits AS (SELECT series_id, nr // {_g.refit_every_origins} AS block, pos AS f FROM nth WHERE nr % {_g.refit_every_origins} = 0),
seq AS (
  SELECT t.series_id, t.block, p.pos - t.f + {_W - 1} AS j, (p.r * {_S}::DOUBLE) * (p.r * {_S}::DOUBLE) AS s FROM fits t JOIN panel p ON p.series_id = t.series_id AND p.pos BETWEEN t.f - {_W - 1} AND t.f
  UNION ALL SELECT series_id, nr // {_g.refit_every_origins}, {_W - 1} + nr % {_g.refit_every_origins}, (r * {_S}::DOUBLE) * (r * {_S}::DOUBLE) FROM nth WHERE nr % {_g.refit_every_origins} > 0),
begun AS (SELECT series_id, block, sum(s * pow({garch.BACKCAST_DECAY}::DOUBLE, j)) / sum(pow({garch.BACKCAST_DECAY}::DOUBLE, j)) AS v FROM seq WHERE j < {min(_W, garch.BACKCAST_TERMS)} GROUP BY ALL),
chain AS (
  SELECT series_id, block, 0::BIGINT AS j, {_NEXT.format("v", "v")} AS v FROM begun
  UNION ALL SELECT c.series_id, c.block, c.j + 1, {_NEXT.format("q.s", "c.v")} FROM chain c JOIN seq q ON q.series_id = c.series_id AND q.block = c.block AND q.j = c.j)"""
_QUANTILES = {models.GARCH_GAUSSIAN: (Z_05, Z_01), models.GARCH_STUDENT_T: standardised_quantiles(STORED_TAIL)}
_KINDS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in _QUANTILES.items())
SQL["garch_stored_forecasts"] = _sql(f""", {_CHAIN}
SELECT n.series_id, model_id, forecast_origin, target_date, round(v / {_S**2}, 9) AS variance, round(sqrt(v / {_S**2}), 9) AS volatility,
  round(sqrt(v / {_S**2}) * z05, 9) AS return_quantile_0_05, round(greatest(0.0, -(sqrt(v / {_S**2}) * z05)), 9) AS var_0_95,
  round(sqrt(v / {_S**2}) * z01, 9) AS return_quantile_0_01, round(greatest(0.0, -(sqrt(v / {_S**2}) * z01)), 9) AS var_0_99, 'ok' AS status, NULL::VARCHAR AS error_code
FROM nth n JOIN chain c ON c.series_id = n.series_id AND c.block = n.nr // {_g.refit_every_origins} AND c.j = {_W} + n.nr % {_g.refit_every_origins}, (VALUES {_KINDS}) k(model_id, z05, z01)""")
_FRONT = math.lgamma((STORED_TAIL + 1) / 2) - math.lgamma(STORED_TAIL / 2) - 0.5 * math.log(math.pi * (STORED_TAIL - 2))
SQL["garch_stored_likelihoods"] = _sql(f""", {_CHAIN}
SELECT c.series_id, c.block::INTEGER AS fit_block, d.degrees_of_freedom, round(sum(CASE WHEN d.degrees_of_freedom IS NULL THEN -0.5 * (ln(2 * pi()) + ln(v) + s / v)
  ELSE {_FRONT}::DOUBLE - 0.5 * ln(v) - {(STORED_TAIL + 1) / 2} * ln(1 + s / (v * {STORED_TAIL - 2})) END), 9) AS log_likelihood
FROM chain c JOIN seq q ON q.series_id = c.series_id AND q.block = c.block AND q.j = c.j, (VALUES (NULL::DOUBLE), ({STORED_TAIL}::DOUBLE)) d(degrees_of_freedom) WHERE c.j < {_W} GROUP BY ALL""")

_SUPPLIERS = """SELECT 'S' || key AS series_id, date, (row_number() OVER (PARTITION BY key ORDER BY date) - 1)::INTEGER AS pos, r FROM (
  SELECT key, date, level / lag(level) OVER (PARTITION BY key ORDER BY date) - 1 AS r FROM (
    SELECT l_suppkey::INTEGER AS key, date_trunc('week', l_shipdate)::DATE AS date, ln(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*)) AS level FROM lineitem GROUP BY 1, 2)) WHERE r IS NOT NULL"""


def _of_suppliers(sql: str) -> str:
    """The same query over the panel of suppliers."""
    return sql.replace(f"panel AS ({_CTE['panel']})", f"panel AS ({_SUPPLIERS})")


SQL |= {f"supplier_{k}": _of_suppliers(SQL[v]) for k, v in (("variance_scores", "variance_scores"), ("quantile_scores", "quantile_scores"), ("exception_counts", "exception_counts"), ("point_estimates", "bootstrap_point_estimates"), ("stored_forecasts", "garch_stored_forecasts"))}
SQL["supplier_panel"] = _of_suppliers(_sql("SELECT series_id, date, pos, round(r, 9) AS simple_return FROM panel"))
SQL["supplier_directions"] = _of_suppliers(_sql(
    """SELECT period, series_id, model_id, benchmark_model_id, metric, paired_count, round(value, 9) AS value, round(value - half, 9) AS interval_lower, round(value + half, 9) AS interval_upper,
  CASE WHEN value + half < 0 THEN 'candidate_better' WHEN value - half > 0 THEN 'benchmark_better' ELSE 'open' END AS verdict
FROM (SELECT period, series_id, model_id, benchmark_model_id, metric, count(*) AS paired_count, avg(difference) AS value, 1.96 * stddev_samp(difference) / sqrt(count(*)) AS half FROM pairs GROUP BY ALL)"""
))
SQL["supplier_pixels"] = _of_suppliers(_sql(
    """, points AS (SELECT e.series_id, date - DATE '1970-01-01' AS x, round(sqrt(variance), 9) AS y FROM ew e JOIN panel p ON p.series_id = e.series_id AND p.pos = e.pos),
placed AS (SELECT *, (x - min(x) OVER ()) * 40 // (max(x) OVER () - min(x) OVER () + 1) AS col FROM points)
SELECT DISTINCT series_id, x::INTEGER AS x, y FROM placed QUALIFY row_number() OVER (PARTITION BY series_id, col ORDER BY x, y) = 1 OR row_number() OVER (PARTITION BY series_id, col ORDER BY x DESC, y DESC) = 1
  OR row_number() OVER (PARTITION BY series_id, col ORDER BY y, x) = 1 OR row_number() OVER (PARTITION BY series_id, col ORDER BY y DESC, x DESC) = 1"""
))
_FORECASTS_AT = lambda *place: f"(SELECT count(*) FROM forecasts WHERE {_planted(*place)})"
SQL["every_artifact_fault"] = _sql(f"""SELECT fault, n FROM (VALUES
  ('an origin is not before its target', {_FORECASTS_AT("A", 1999)}), ('a window does not end at its origin', {_FORECASTS_AT("N", 1999)}),
  ('a forecast has no window', {_FORECASTS_AT("A", 1999)} + {_FORECASTS_AT("R", 1999)}), ('a window has no forecast', {_FORECASTS_AT("A", 1999)} + {_FORECASTS_AT("A", 2000)}),
  ('a forecast id repeats', 1), ('a forecast key repeats', {_FORECASTS_AT("R", 2000)}), ('a realization key repeats', (SELECT count(*) FROM real WHERE series_id = '{PROXY}' AND period = 'validation')),
  ('a forecast has no realization', {_FORECASTS_AT("A", 1999)} + (SELECT count(*) FROM forecasts JOIN real USING (series_id, forecast_origin, target_date) WHERE series_id = 'N' AND period = 'validation')),
  ('a candidate''s fit has no diagnostics', 1), ('a fit''s diagnostics repeat', 1), ('a fit has no forecasts', 1)) t(fault, n)""")
_ROWS_AT = lambda key, place: f"(SELECT count(*) FROM ({SQL[key]}) WHERE {place})"
_PAIRS_AT = lambda series, period: _ROWS_AT("bootstrap_point_estimates", f"series_id = '{series}' AND period = '{period}' AND model_id = '{models.EWMA}'")
SQL["every_reconciliation_fault"] = f"""SELECT fault, n FROM (VALUES
  ('counts do not add up', 1), ('scores do not match valid forecasts', {_ROWS_AT("variance_scores", f"series_id = 'N' AND period = 'validation' AND model_id = '{models.HISTORICAL_VARIANCE}'")}),
  ('pairs exceed scores', {_PAIRS_AT("R", "test")} + {_PAIRS_AT("N", "test")}), ('coverage does not match scores', {_ROWS_AT("coverage_tests", f"series_id = '{PROXY}' AND period = 'test' AND model_id = '{models.HISTORICAL_SIMULATION}'")}),
  ('a comparison counts other observations than pairs', {_PAIRS_AT("R", "validation")}), ('a period is neither validation nor test', {_PAIRS_AT("N", "test")}),
  ('a breakdown is of no declared year', {_ROWS_AT("period_breakdowns", "period = 'test_2001'")})) t(fault, n) WHERE n > 0"""
