import math
from dataclasses import replace
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from helpers import business_days
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.errors import BY_CODE
from riskloom.functions import ids, scoring
from riskloom.operators import evaluation, panel, reporting
from riskloom.plans.panels import PROFILE

CONFIG = replace(PROFILE, evaluation=replace(PROFILE.evaluation, bootstrap_block_length=2, bootstrap_resamples=100), periods=replace(PROFILE.periods, test_start=date(2020, 1, 1), test_end=date(2020, 12, 31)))
TARGETS = [(date(2019, 12, 26), date(2019, 12, 27), -0.01, "validation"), (date(2019, 12, 27), date(2019, 12, 30), 0.005, "validation"), (date(2019, 12, 31), date(2020, 1, 2), -0.02, "test"), (date(2020, 1, 2), date(2020, 1, 3), 0.01, "test")]


@pytest.fixture(scope="module")
def saved(spark):
    happened = spark.createDataFrame([("A", o, t, r, r * r, -r, p) for o, t, r, p in TARGETS], "series_id string, forecast_origin date, target_date date, simple_return double, squared_return double, loss double, period string")
    rows = []
    for model in ("historical_variance", "historical_simulation", "ewma", "garch_1_1_gaussian", "garch_1_1_student_t"):
        for i, (o, t, _, _) in enumerate(TARGETS):
            v = None if model == "historical_simulation" else 0.0004
            q = (None, None) if model == "historical_variance" else (-0.03, -0.05)
            ok = not (model == "garch_1_1_student_t" and i == 3)
            rows.append(("x", "A", model, o, t, v if ok else None, q[0] if ok else None, q[0] and ok and -q[0] or None, q[1] if ok else None, q[1] and ok and -q[1] or None, "ok" if ok else "failed"))
    schema = "experiment_id string, series_id string, model_id string, forecast_origin date, target_date date, variance double, return_quantile_0_05 double, var_0_95 double, return_quantile_0_01 double, var_0_99 double, status string"
    return spark.createDataFrame(rows, schema), happened


@pytest.fixture(scope="module")
def tables(saved):
    return evaluation.evaluate(*saved, CONFIG)


def one(df, where):
    rows = df.where(where).collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_availability(tables):
    key = "period = 'test' AND model_id = 'garch_1_1_student_t' AND series_id = 'ALL' AND metric = "
    assert [one(tables["forecast_availability"], f"{key} '{m}'").value for m in ("total_eligible_target_dates", "valid_forecast_count", "failed_forecast_count", "unavailable_forecast_count")] == [2, 1, 1, 0]


def test_scores(tables):
    got = one(tables["variance_scores"], "period = 'test' AND model_id = 'ewma' AND series_id = 'A' AND metric = 'qlike'")
    assert math.isclose(got.value, math.log(0.0004) + (0.0004 + 0.0001) / 2 / 0.0004) and got.observation_count == 2
    got = one(tables["quantile_scores"], "period = 'validation' AND model_id = 'ewma' AND series_id = 'ALL' AND metric = 'pinball_loss_0_05'")
    assert math.isclose(got.value, 0.05 * (0.02 + 0.035) / 2) and (got.confidence_level, got.tail_probability) == (0.95, 0.05)


def test_comparisons_pair_by_pair_on_a_full_grid(tables):
    c = tables["bootstrap_comparisons"]
    assert c.count() == 5 * 2 * 3 * 2
    got = one(c, "period = 'test' AND model_id = 'garch_1_1_student_t' AND series_id = 'A' AND metric = 'qlike'")
    assert got.paired_count == 1 and got.effect_direction == "tie" and got.value == 0 == got.interval_lower and got.fraction_below_zero == 0


def test_no_pairs_give_nulls(saved):
    f, r = saved
    c = evaluation.evaluate(f.where("model_id <> 'ewma'"), r, CONFIG)["bootstrap_comparisons"]
    got = one(c, "period = 'test' AND model_id = 'ewma' AND series_id = 'A' AND metric = 'qlike'")
    assert (got.paired_count, got.value, got.effect_direction) == (0, None, "unavailable")


def test_breakdowns_and_reconciliation(tables):
    got = one(tables["period_breakdowns"], "series_id = 'A' AND model_id = 'garch_1_1_student_t' AND metric = 'failed_forecast_count'")
    assert (got.period, got.observation_count, got.value, got.period_start, got.period_end) == ("test_2020", 2, 1.0, "2020-01-01", "2020-12-31")
    assert {r.metric for r in tables["period_breakdowns"].where("model_id = 'ewma'").select("metric").distinct().collect()} >= {"exception_rate_0_05", "exception_rate_0_01"}
    assert reporting.reconciliation(tables).count() == 0
    off = tables | {"coverage_tests": tables["coverage_tests"].withColumn("observation_count", F.col("observation_count") + 1)}
    assert [r.fault for r in reporting.reconciliation(off).collect()] == ["coverage does not match scores"]


def test_a_forecast_without_realization_fails(saved):
    f, r = saved
    with pytest.raises(Exception, match="WINDOW_ALIGNMENT_ERROR"):
        evaluation.joined(f, r.where("target_date > date'2019-12-28'")).collect()


def sequence(spark, flags):
    rows = [("test", "A", "ewma", 0.95, 0.05, date.fromordinal(737000 + i), f) for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "period string, series_id string, model_id string, confidence_level double, tail_probability double, target_date date, exception boolean")


def test_golden_coverage(spark):
    keys = ["period", "series_id", "model_id", "confidence_level", "tail_probability"]
    flags = [c == "T" for c in "FFTTFTFFTF"]
    counts = evaluation.exception_counts(sequence(spark, flags), keys).withColumn("tail_probability", F.lit(0.20))
    got = evaluation.coverage_wide(counts).first()
    assert (got.n00, got.n01, got.n10, got.n11, got.longest_exception_cluster, got.exception_count) == (2, 3, 3, 1, 2, 4)
    for name, want in (("kupiec_lr", 2.092992575058192), ("kupiec_p_value", 0.1479759593850231), ("christoffersen_independence_lr", 1.1365105517087883), ("conditional_coverage_lr", 3.2295031267669803)):
        assert math.isclose(got[name], want, rel_tol=1e-12), name
    none = evaluation.coverage_wide(evaluation.exception_counts(sequence(spark, [False] * 20), keys)).first()
    assert none.christoffersen_status == "insufficient_events" and none.christoffersen_independence_lr is None and none.kupiec_lr > 0 and none.longest_exception_cluster == 0


def test_scalar_scores(spark):
    row = spark.range(1).select(
        scoring.qlike(F.lit(0.04), F.lit(0.01)).alias("q"), scoring.squared_error(F.lit(0.04), F.lit(0.01)).alias("s"), scoring.absolute_error(F.lit(0.04), F.lit(0.01)).alias("a"),
        scoring.pinball(F.lit(-0.02), F.lit(-0.03), 0.05).alias("below"), scoring.pinball(F.lit(-0.02), F.lit(-0.01), 0.05).alias("above"), scoring.pinball(F.lit(0.5), F.lit(0.5), 0.05).alias("at"),
        scoring.exception(F.lit(0.02), F.lit(0.02)).alias("equal"), scoring.exception(F.lit(0.03), F.lit(0.02)).alias("over"),
    ).first()
    assert math.isclose(row.q, math.log(0.04) + 0.25) and math.isclose(row.s, 0.0009) and math.isclose(row.a, 0.03)
    assert math.isclose(row.below, 0.0095) and math.isclose(row.above, 0.0005) and row["at"] == 0 and (row.equal, row.over) == (False, True)
    with pytest.raises(Exception, match="WINDOW_ALIGNMENT_ERROR"):
        spark.range(1).select(scoring.exception(F.lit(0.1), F.lit(-0.1))).collect()


def test_bootstrap_draws():
    groups = [np.array([-2.0, -1, 0, 1]), np.array([2.0, 3, 4, 5])]
    got = evaluation.block_means(groups, 2, 100, 42)
    rng, sums = np.random.default_rng(42), np.zeros(100)
    for g in groups:
        starts = rng.integers(0, 3, size=(100, 2))
        sums += np.array([sum(g[s] + g[s + 1] for s in row) for row in starts])
    assert np.allclose(got, sums / 8) and np.array_equal(got, evaluation.block_means(groups, 2, 100, 42))
    for bad in ([], [np.array([])]):
        with pytest.raises(BY_CODE["WINDOW_ALIGNMENT_ERROR"]):
            evaluation.block_means(bad, 2, 10, 1)


def test_intervals_by_series_and_pooled_follow_one_stream(spark):
    rng, days = np.random.default_rng(3), [date(2020, 1, 1 + i) for i in range(20)]
    groups = {"b": rng.normal(size=20), "A": rng.normal(size=7), "a": rng.normal(size=1)}
    rows = [("test", "ewma", "h", "qlike", s, days[i], float(v)) for s, values in groups.items() for i, v in enumerate(values)]
    pairs = spark.createDataFrame(rows[::-1], "period string, model_id string, benchmark_model_id string, metric string, series_id string, target_date date, difference double")
    got = {r.series_id: r for r in evaluation.intervals(pairs, CONFIG).collect()}
    e, seed = CONFIG.evaluation, CONFIG.experiment.random_seed
    tail = (1 - e.bootstrap_confidence) / 2
    for name, parts in {**{s: [v] for s, v in groups.items()}, "ALL": [groups[s] for s in sorted(groups)]}.items():
        means = evaluation.block_means(parts, e.bootstrap_block_length, e.bootstrap_resamples, seed)
        want = (np.quantile(means, tail), np.quantile(means, 1 - tail), np.mean(means < 0))
        assert np.allclose(want, (got[name].interval_lower, got[name].interval_upper, got[name].fraction_below_zero))
    assert set(got) == {*groups, "ALL"}


def test_ids(spark):
    assert ids.canonical_json({"b": 1, "a": [None, True, "é"], "d": date(2020, 1, 2)}) == '{"a":[null,true,"é"],"b":1,"d":"2020-01-02"}'
    for bad in (math.nan, object()):
        with pytest.raises(BY_CODE["CONFIG_INVALID"]):
            ids.canonical_json({"a": bad})
    values = dict(zip(ids.FORECAST_FIELDS, ["x", "fit_1", "É", "m", datetime(2020, 1, 1), datetime(2020, 1, 2)], strict=True))
    df = spark.createDataFrame([("fit_1", "É", "m", date(2020, 1, 1), date(2020, 1, 2))], "f string, s string, m string, o date, t date")
    got = df.select(ids.forecast_id("x", F.col("f"), F.col("s"), F.col("m"), F.col("o"), F.col("t"))).first()[0]
    assert got == ids.deterministic_id("fcst_", values) and len(got) == 29
    with pytest.raises(BY_CODE["CONFIG_INVALID"]):
        ids.deterministic_id("", {})


def differences(spark, rows):
    schema = T.StructType.fromDDL("period string, model_id string, metric string, series_id string, target_date date, difference double")
    return spark.createDataFrame([("test", "ewma", "qlike", s, date(2020, 1, d), float(x)) for s, d, x in rows], schema)


def test_rolling_advantage_needs_a_balanced_full_window(spark):
    rows = [(s, d, d) for s in "AB" for d in (1, 2, 3, 4)]
    got = [r.rolling_difference for r in reporting.rolling_advantage(differences(spark, rows), 2).orderBy("target_date").collect()]
    assert got == [None, 1.5, 2.5, 3.5]
    rows.remove(("B", 2, 2))
    got = [r.rolling_difference for r in reporting.rolling_advantage(differences(spark, rows), 2).orderBy("target_date").collect()]
    assert got == [None, None, None, 3.5]


def test_calibration_verdicts(spark):
    row = lambda m, s, v: ("test", s, m, "kupiec_p_value", v)
    rows = [row(m, s, v) for m, vs in (("a", [0.5, 0.6, 0.2, 0.9]), ("b", [0.5, 0.01, 0.2, 0.9]), ("c", [0.5, None, 0.2, 0.9])) for s, v in zip("SSTT", vs, strict=True)]
    df = spark.createDataFrame(rows, "period string, series_id string, model_id string, metric string, value double")
    assert {r.model_id: r.verdict for r in reporting.calibration_summary(df, 2).collect()} == {"a": "consistent", "b": "rejected", "c": "incomplete"}


def test_overlapping_periods(spark):
    df = spark.createDataFrame([("test", date(2020, 1, 1)), ("validation", date(2020, 1, 1))], "period string, target_date date")
    with pytest.raises(BY_CODE["ARTIFACT_RECONCILIATION_FAILED"]):
        reporting.period_context(df)


def test_pooled_medians_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"many": rng.standard_cauchy(60_000), "ties": rng.integers(0, 3, 30_001).astype(float), "two": np.array([1.0, 4.0]), "one": np.array([-2.5]), "same": np.zeros(9)}
    rows = spark.createDataFrame(pd.DataFrame([(k, x) for k, v in groups.items() for x in v], columns=["k", "x"])).repartition(7)
    got = {r.k: r for r in evaluation.exact_medians(rows, ["k"], "x").collect()}
    assert set(got) == set(groups)
    assert all(got[k].median == np.median(v) and got[k].n == len(v) and math.isclose(got[k].mean, v.mean(), rel_tol=1e-9, abs_tol=1e-12) for k, v in groups.items())


def by_hand(flags):
    """Counts of a sequence of exceptions."""
    pairs = list(zip(flags, flags[1:], strict=False))
    runs = "".join(map(str, flags)).split("0")
    return (len(flags), sum(flags), *[pairs.count((i, j)) for i in (0, 1) for j in (0, 1)], max(map(len, runs)))


def test_exceptions_over_many_stretches(spark):
    """Runs that cross the borders of stretches, series of every kind."""
    rng = np.random.default_rng(5)
    days = business_days(date(1990, 1, 1), 2000)
    series = {"none": [0] * 2000, "all": [1] * 2000, "long": [0] * 100 + [1] * 900 + [0] * 1000, "one": [1], "mixed": rng.integers(0, 2, 2000).tolist(), "rare": (rng.random(1500) < 0.03).astype(int).tolist()}
    rows = [(k, d, bool(x)) for k, v in series.items() for d, x in zip(days, v, strict=False)]
    df = spark.createDataFrame(rows, "k string, target_date date, exception boolean").repartition(6)
    got = {r.k: tuple(r)[1:] for r in evaluation.exception_counts(df, ["k"]).collect()}
    assert got == {k: by_hand(v) for k, v in series.items()}


def test_block_sums_equal_the_blocks(spark):
    values = np.random.default_rng(1).normal(size=57)
    for block in (1, 5, 20, 57, 90):
        got = evaluation.resampled_sums(values, block, 40, np.random.default_rng(7))
        b = min(block, 57)
        starts = np.random.default_rng(7).integers(0, 57 - b + 1, size=(40, math.ceil(57 / b)))
        want = [np.concatenate([values[s : s + b] for s in row])[:57].sum() for row in starts]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_draws_do_not_depend_on_how_many_are_drawn_at_once(monkeypatch):
    whole = np.concatenate(list(evaluation.drawn_starts(1000, 7, 300, np.random.default_rng(3))))
    monkeypatch.setattr(evaluation, "DRAWN", 999)
    assert (np.concatenate(list(evaluation.drawn_starts(1000, 7, 300, np.random.default_rng(3)))) == whole).all()


def test_figures_show_every_extreme(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(x), float(rng.normal())) for s in "AB" for x in range(1000, 4000)]
    df = spark.createDataFrame(rows, "s string, x int, y double")
    got = reporting.pixel_columns(df, ["s"], 50).collect()
    assert len(got) <= 2 * 4 * 50
    for s in "AB":
        own, shown = [r[1:] for r in rows if r[0] == s], {(r.x, r.y) for r in got if r.s == s}
        for c in range(50):
            column = [p for p in own if (p[0] - 1000) * 50 // 3000 == c]
            assert {min(column), max(column), min(column, key=lambda p: p[1]), max(column, key=lambda p: p[1])} <= shown


def test_a_proxy_of_many_series(spark):
    """Five hundred series; one date lacks one of them."""
    rng = np.random.default_rng(4)
    names, days = [f"s{i}" for i in range(500)], business_days(date(2020, 1, 1), 4)
    values = rng.normal(0, 0.01, (4, 500))
    rows = [(k, i, d, t, float(values[t, i])) for t, d in enumerate(days) for i, k in enumerate(names) if (t, i) != (2, 7)]
    df = spark.createDataFrame(rows, "series_id string, series_pos int, date date, pos int, simple_return double")
    weights = dict.fromkeys(names, 1 / 500)
    got = {r.date: r for r in panel.with_long_proxy(df, weights, "MIX").where("series_id = 'MIX'").collect()}
    assert [days.index(d) for d in sorted(got)] == [0, 1, 3] and [got[d].pos for d in sorted(got)] == [0, 1, 2]
    for t in (0, 1, 3):
        total = 0.0
        for i in range(500):
            total = total + values[t, i] * weights[names[i]]
        assert got[days[t]].simple_return == total and got[days[t]].series_pos == 500
    with pytest.raises(BY_CODE["CONFIG_INVALID"]):
        panel.with_long_proxy(df, {"s0": 0.5}, "MIX")


@pytest.mark.parametrize(
    ("table", "change", "fault"),
    [
        ("forecast_availability", lambda t: t.withColumn("value", F.when(F.col("metric") == "failed_forecast_count", F.col("value") + 1).otherwise(F.col("value"))), "counts do not add up"),
        ("bootstrap_comparisons", lambda t: t.withColumn("observation_count", F.col("observation_count") + 1), "a comparison counts other observations than pairs"),
        ("coverage_tests", lambda t: t.withColumn("period", F.lit("development")), "a period is neither validation nor test"),
        ("period_breakdowns", lambda t: t.withColumn("period", F.lit("test_1900")), "a breakdown is of no declared year"),
    ],
)
def test_each_gate_names_its_fault(tables, table, change, fault):
    years = evaluation.test_years(CONFIG)
    reporting.check_reconciled(tables, years)
    off = tables | {table: change(tables[table])}
    assert fault in {r.fault for r in reporting.reconciliation(off, years).collect()}
    with pytest.raises(BY_CODE["ARTIFACT_RECONCILIATION_FAILED"], match=fault):
        reporting.check_reconciled(off, years)
    with pytest.raises(BY_CODE["WINDOW_ALIGNMENT_ERROR"]):
        reporting.check_reconciled(tables | {table: tables[table].drop("period")}, years)
