import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from helpers import business_days

from riskloom.config import Garch, Periods
from riskloom.errors import BY_CODE
from riskloom.functions import special
from riskloom.operators import garch, models, recursions, windows


def panel_of(spark, series: dict[str, list[float]]):
    rows = []
    for at, (name, values) in enumerate(series.items()):
        rows += [(name, at, d, p, float(r)) for p, (d, r) in enumerate(zip(business_days(date(2020, 1, 1), len(values)), values, strict=True))]
    return spark.createDataFrame(rows, "series_id string, series_pos int, date date, pos int, simple_return double")


@pytest.fixture(scope="module")
def returns():
    return np.random.default_rng(3).normal(0, 0.01, 90).tolist()


def path(df, column="variance"):
    return {(r.series_id, r.pos): r[column] for r in df.collect()}


def test_rolling_variance_equals_pandas(spark, returns):
    got = path(models.variance_path(panel_of(spark, {"A": returns}), 20))
    want = pd.Series(returns).rolling(20).var()
    assert len(got) == 71 and all(math.isclose(got["A", p], want[p], rel_tol=1e-9) for p in range(19, 90))


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "midpoint", "nearest"])
def test_rolling_quantiles_equal_pandas(spark, returns, method):
    got = models.simulation_path(panel_of(spark, {"A": returns}), 31, method).collect()
    for p, name in ((0.05, "return_quantile_0_05"), (0.01, "return_quantile_0_01")):
        want = pd.Series(returns).rolling(31).quantile(p, interpolation=method)
        assert all(math.isclose(r[name], want[r.pos], rel_tol=1e-9, abs_tol=1e-15) for r in got)
    assert all(r.var_0_95 == max(0.0, -r.return_quantile_0_05) for r in got)


def test_value_at_risk_is_never_negative(spark):
    rows = models.simulation_path(panel_of(spark, {"A": [0.01, 0.02, 0.03, 0.04]}), 3).collect()
    assert all(r.return_quantile_0_05 > 0 and r.var_0_95 == 0 for r in rows)


def test_one_window_form_equals_the_path(spark, returns):
    one = models.one_window(iter(returns[:31]), 31)
    path_ = models.simulation_path(panel_of(spark, {"A": returns}), 31).where("pos = 30").first()
    assert math.isclose(one["return_quantile_0_05"], path_.return_quantile_0_05, rel_tol=1e-12)
    with pytest.raises(BY_CODE["INSUFFICIENT_HISTORY"]):
        models.one_window(iter(returns[:30]), 31)
    with pytest.raises(BY_CODE["INPUT_VALUE_INVALID"]):
        models.one_window(iter([math.nan] * 31), 31)


def test_ewma_by_hand_and_decay(spark):
    r = [0.01, -0.02, 0.03, 0.0, 0.0]
    got = path(models.ewma_path(panel_of(spark, {"A": r}), 0.9, 2))
    v = float(np.var(r[:2], ddof=1))
    for p, x in enumerate(r[1:], start=1):
        v = v if p == 1 else 0.9 * v + 0.1 * x * x
        assert math.isclose(got["A", p], v, rel_tol=1e-14)
    assert math.isclose(got["A", 4], 0.81 * got["A", 2], rel_tol=1e-12)


def test_appended_returns_change_nothing_earlier_and_scale_is_square(spark, returns):
    short, long = panel_of(spark, {"A": returns[:60]}), panel_of(spark, {"A": returns, "B": [3 * r for r in returns]})
    for run in (lambda p: models.ewma_path(p, 0.94, 20), lambda p: models.variance_path(p, 20)):
        a, b = path(run(short)), path(run(long))
        assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)
        assert all(math.isclose(b["B", p], 9 * b["A", p], rel_tol=1e-9) for p in range(25, 90))


def test_special_functions():
    assert math.isclose(special.chi_square_tail(2.092992575058192, 1), 0.1479759593850231, rel_tol=1e-12)
    # Quantiles from published tables of Student's t.
    for df, p05, p01 in ((3, -2.353363, -4.540703), (5, -2.015048, -3.364930), (8, -1.859548, -2.896459), (10, -1.812461, -2.763769), (30, -1.697261, -2.457262)):
        assert math.isclose(special.t_quantile(0.05, df), p05, abs_tol=2e-6) and math.isclose(special.t_quantile(0.01, df), p01, abs_tol=2e-6)
    assert math.isclose(special.standardised_quantiles(1e6)[0], special.Z_05, abs_tol=1e-5)
    assert special.t_quantile(0.95, 5) == -special.t_quantile(0.05, 5)


CONFIG = Garch(200, 20)


def simulated(n: int, seed: int = 5) -> np.ndarray:
    rng, v, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        r = math.sqrt(v) * rng.normal()
        out.append(r)
        v = 0.05 + 0.1 * r * r + 0.85 * v
    return np.array(out) / 100


def test_variances_follow_the_recursion():
    r, p = simulated(300) * 100, garch.Parameters(0.05, 0.08, 0.9)
    v = garch.variances(r, p)
    for t in range(1, 300):
        assert math.isclose(v[t], p.omega + p.alpha * r[t - 1] ** 2 + p.beta * v[t - 1], rel_tol=1e-9)


@pytest.mark.parametrize("student", [False, True])
def test_fit_finds_a_better_likelihood_than_the_truth(student):
    r = simulated(1500)
    got = garch.fit(r, Garch(1500, 20), student)
    assert got.converged and got.state and got.error_code is None
    truth = garch.Parameters(0.05, 0.1, 0.85, got.parameters.degrees_of_freedom)
    assert garch.log_likelihood(r * 100, got.parameters) >= garch.log_likelihood(r * 100, truth) - 1e-6
    assert abs(got.parameters.persistence - 0.95) < 0.1


def test_outcomes_of_failures():
    r, good = simulated(200), garch.Parameters(0.05, 0.05, 0.9)
    starts = []

    def unsure(scaled, start):
        starts.append(start)
        return good, False, "no"

    out = garch.fit(r, CONFIG, False, unsure)
    assert (out.error_code, out.converged, out.retry_used, out.state) == ("MODEL_FIT_FAILED", False, True, None)
    assert starts[1] == garch.Parameters(0.05 * float(np.var(r * 100, ddof=1)), 0.05, 0.90, None)
    out = garch.fit(r, CONFIG, False, lambda s, x: (garch.Parameters(0.05, 0.2, 0.9), True, "yes"))
    assert (out.error_code, out.converged, out.state) == ("NONSTATIONARY_PARAMETERS", True, None) and out.parameters.alpha == 0.2
    out = garch.fit(r, CONFIG, True, lambda s, x: (garch.Parameters(0.05, 0.05, 0.9, 1.5), True, "yes"))
    assert out.error_code == "INVALID_STUDENT_T_DOF"
    first = iter([(good, False, "no"), (good, True, "yes")])
    out = garch.fit(r, CONFIG, False, lambda s, x: next(first))
    assert out.state and out.retry_used
    with pytest.raises(BY_CODE["INSUFFICIENT_HISTORY"]):
        garch.fit(r[:-1], CONFIG, False)


def chunk(n: int, bad_at: int | None = None) -> pd.DataFrame:
    """A window of 200 returns, the last of which is the first of n origins."""
    returns = [*simulated(200).tolist(), *[0.01] * (n - 1)]
    if bad_at is not None:
        returns[199 + bad_at] = math.nan
    days = business_days(date(2020, 1, 1), len(returns) + 1)
    rows = pd.DataFrame({"series_id": "A", "chunk": 0, "pos": np.arange(len(returns)), "date": days[:-1], "target_date": days[1:], "simple_return": returns, "at": [-1] * 199 + list(range(n))})
    return rows.sample(frac=1, random_state=1)


def fixed(scaled, start):
    return garch.Parameters(0.05, 0.05, 0.90, start.degrees_of_freedom), True, "fixed"


def test_the_origin_return_is_applied_once():
    got = garch.run_chunk(chunk(3), CONFIG, fixed)
    assert sorted(set(got["model_id"])) == sorted(garch.MODELS) and got["fit_start"].nunique() == 1
    for model in garch.MODELS:
        r = simulated(200) * 100
        v = garch.variances(r, garch.Parameters(0.05, 0.05, 0.90))[-1]
        for row, x in zip(got[got["model_id"] == model].itertuples(), [r[-1], 1.0, 1.0], strict=True):
            v = 0.05 + 0.05 * x * x + 0.90 * v
            assert math.isclose(row.variance, v / 1e4, rel_tol=1e-12) and row.status == "ok"


def test_a_failure_lasts_to_the_end_of_its_block():
    got = garch.run_chunk(chunk(4, bad_at=1), CONFIG, fixed)
    got = got[got["model_id"] == garch.GARCH_GAUSSIAN]
    assert got["status"].tolist() == ["ok", "failed", "failed", "failed"]
    assert got["error_code"].tolist() == [None, *["INPUT_VALUE_INVALID"] * 3]
    assert got["variance"].isna().tolist() == [False, True, True, True]


def test_chunks_are_walked_and_judged_side_by_side(monkeypatch):
    """Many blocks at once equal one state at a time, with a fault in one of them, and a chunk
    makes as many passes over time as one fit does."""
    rng = np.random.default_rng(5)
    states = [garch.State(garch.Parameters(0.05, 0.05 + i / 100, 0.8, None), 1.0 + i) for i in range(5)] + [None]
    states[3] = garch.State(garch.Parameters(0.05, 2.0, 1e200, None), 1e200)
    returns, counts = rng.normal(0, 0.01, (6, 7)), np.array([7, 7, 3, 7, 7, 2])
    returns[1, 4] = math.nan
    path, good, fault = garch.walked_all(states, returns, counts, 100.0)
    for i, state in enumerate(states[:5]):
        want, code = garch.walked(state, returns[i, : counts[i]], 100.0)
        assert good[i] == len(want) and fault[i] == code and np.allclose(path[i, : good[i]], want, rtol=1e-14)
    assert good[5] == 0 and fault[5] is None
    calls, plain = [], garch.recursion
    monkeypatch.setattr(garch, "recursion", lambda r, p: calls.append(len(r)) or plain(r, p))
    one = garch.run_chunk(chunk(20), CONFIG, fixed)
    few = len(calls)
    many = garch.run_chunk(chunk(400), CONFIG, fixed)
    assert len(calls) == 2 * few and len(many) > 10 * len(one) / 2 and (many["status"] == "ok").all()


def by_blocks(panel: pd.DataFrame, config: Garch, eligible: set[int], model: str) -> dict:
    """Variances by origin, one fit at a time."""
    out, origins = {}, sorted(eligible)
    r = panel["simple_return"].to_numpy()
    for a in range(0, len(origins), config.refit_every_origins):
        f = origins[a]
        found = garch.fit(r[f - config.estimation_window + 1 : f + 1], config, model == garch.GARCH_STUDENT_T, fixed)
        v = found.state.variance_scaled
        for at in origins[a : a + config.refit_every_origins]:
            v = 0.05 + 0.05 * (100 * r[at]) ** 2 + 0.90 * v
            out[at] = v / 1e4
    return out


def test_chunks_equal_fits_one_at_a_time(spark):
    """Two series, a gap between the periods, chunks of three fits."""
    n, config = 230, Garch(30, 7)
    days = business_days(date(2020, 1, 1), n)
    periods = Periods(days[0], days[80], days[81], days[120], days[150], days[-1])
    rng = np.random.default_rng(4)
    panel = panel_of(spark, {"A": rng.normal(0, 0.01, n).tolist(), "B": rng.normal(0, 0.02, 100).tolist()})
    given = (garch.Parameters(0.05, 0.05, 0.90), garch.Parameters(0.05, 0.05, 0.90, 8.0))
    rows = garch.garch_rows(panel, config, periods, lambda scaled, start: (given[start.degrees_of_freedom is not None], True, "given"), fits=3)
    assert "collect_list" not in rows._jdf.queryExecution().toString()
    got = {(r.series_id, r.model_id, days.index(r.forecast_origin)): r for r in rows.collect()}
    want = {}
    for name, size in (("A", n), ("B", 100)):
        eligible = {p for p in range(29, size - 1) if any(a <= days[p + 1] <= b for _, a, b in periods.ranges())}
        for model in garch.MODELS:
            series = pd.DataFrame({"simple_return": [r.simple_return for r in panel.where(f"series_id = '{name}'").orderBy("pos").collect()]})
            want |= {(name, model, at): v for at, v in by_blocks(series, config, eligible, model).items()}
    assert set(got) == set(want) and all(math.isclose(got[k].variance, want[k], rel_tol=1e-12) for k in want)
    chunks = windows.refit_chunks(panel, 30, 7, periods, 3)
    assert chunks.groupBy("series_id", "chunk", "pos").count().where("count > 1").count() == 0


@pytest.mark.parametrize("tail", [(), (6.0,), (3000.0,)])
def test_slopes_equal_differences(tail):
    r = np.stack([simulated(300, s) * 100 for s in (1, 2)])
    x = np.stack([garch._pack(garch.Parameters(0.05, 0.08, 0.9, *tail)), garch._pack(garch.Parameters(0.4, 0.01, 0.3, *tail))])
    value, g = garch.losses(r, x)
    for i in range(x.shape[1]):
        step = np.zeros(x.shape[1])
        step[i] = 1e-5
        want = (garch.losses(r, x + step)[0] - garch.losses(r, x - step)[0]) / 2e-5
        assert np.allclose(g[:, i], want, rtol=1e-6, atol=1e-9)
    one = [garch.log_likelihood(a, garch._unpack(p)) for a, p in zip(r, x, strict=True)]
    assert np.allclose(-value * 300, one, rtol=1e-12)


def test_student_likelihood_by_hand():
    r, p = simulated(50) * 100, garch.Parameters(0.05, 0.08, 0.9, 5.0)
    v = garch.variances(r, p)
    density = [math.lgamma(3.0) - math.lgamma(2.5) - 0.5 * math.log(math.pi * 3.0 * s) - 3.0 * math.log(1 + x * x / (3.0 * s)) for x, s in zip(r, v, strict=True)]
    assert math.isclose(garch.log_likelihood(r, p), sum(density), rel_tol=1e-12)


def test_windows_fitted_together_and_alone_agree():
    r = simulated(400)
    together = garch.fit_all(np.stack([r[a : a + 200] for a in range(0, 200, 40)]), CONFIG, True)
    alone = [garch.fit(r[a : a + 200], CONFIG, True) for a in range(0, 200, 40)]
    for a, b in zip(together, alone, strict=True):
        assert a.optimizer_status == b.optimizer_status and math.isclose(a.parameters.beta, b.parameters.beta, rel_tol=1e-6)


def test_normal_tails_have_no_bound():
    """White noise has no finite degrees of freedom: the search ends where the slope does."""
    p = garch.Parameters(0.9, 0.01, 0.1, 1e9)
    assert math.isclose(garch._unpack(garch._pack(p)).degrees_of_freedom, 1e9, rel_tol=1e-6)
    r = np.random.default_rng(0).normal(0, 1, 1250)
    assert math.isclose(garch.log_likelihood(r, p), garch.log_likelihood(r, garch.Parameters(0.9, 0.01, 0.1)), rel_tol=1e-9)


def test_a_series_in_blocks_equals_the_recursion(spark):
    r = np.random.default_rng(1).normal(0, 0.01, 20_000)
    df = panel_of(spark, {"A": r.tolist(), "short": r[:59].tolist(), "just": r[:60].tolist()}).repartition(5)
    for decay in (0.94, 0.1):
        got = path(models.ewma_path(df, decay, 60))
        v = float(np.var(r[:60], ddof=1))
        want = {59: v}
        for p in range(60, len(r)):
            v = models.ewma_step(v, r[p], decay)
            want[p] = v
        assert set(got) == {("A", p) for p in want} | {("just", 59)}
        assert all(math.isclose(got["A", p], want[p], rel_tol=1e-12) for p in want)
    got = path(models.garch_filter_path(df, 60, 0.05, 0.05, 0.0))
    assert all(math.isclose(got["A", p], (0.05 + 0.05 * (100 * r[p]) ** 2) / 1e4, rel_tol=1e-12) for p in range(60, len(r)))
    assert 1 <= recursions.block_length(1e-300) < recursions.block_length(0.94) <= recursions.block_length(0.9999) == recursions.BLOCK


def test_a_dealt_panel_gives_the_same_scan(spark, monkeypatch):
    monkeypatch.setattr(recursions, "BLOCK", 16)
    rng = np.random.default_rng(8)
    df = panel_of(spark, {"A": rng.normal(0, 0.01, 100).tolist(), "B": rng.normal(0, 0.02, 30).tolist(), "C": [0.01] * 12})
    want, got = (path(models.with_ewma(df, 0.94, 20, dealt)) for dealt in (False, True))
    assert got.keys() == want.keys() and all(got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-14) for k in want)
    assert sum(v is not None for v in got.values()) == 81 + 11


def test_blocks_of_one_series_are_many_tasks(spark):
    df = panel_of(spark, {"A": [0.01, -0.01] * 20_000})
    plan = models.with_ewma(df, 0.94, 60)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(series_id" in plan and "_block" in plan and "FlatMapGroupsInPandas" in plan
    with pytest.raises(Exception, match="NONPOSITIVE_VARIANCE"):
        models.ewma_path(panel_of(spark, {"A": [0.0] * 100}), 0.94, 60).collect()


def test_state_round_trip():
    s = garch.State(garch.Parameters(0.1, 0.2, 0.3, 5.0), 1.5)
    assert garch.State.from_dict(s.to_dict()) == s
    with pytest.raises(BY_CODE["INPUT_VALUE_INVALID"]):
        garch.State.from_dict({"parameters": {"omega": math.nan, "alpha": 0.1, "beta": 0.2}, "variance_scaled": 1.0})
    with pytest.raises(BY_CODE["NONPOSITIVE_VARIANCE"]):
        models.checked_variance(0.0)


def test_a_search_that_fails_on_a_slope_is_not_converged(monkeypatch):
    """A cliff: the value falls along the slope, but no step is admissible."""
    r, start = simulated(200) * 100, garch.Parameters(0.05, 0.05, 0.9)
    at = garch._pack(start)

    def cliff(returns, x):
        d = x - at
        near = (np.abs(d).max(axis=1) < 1e-4) & ((np.abs(d) > 1e-12).sum(axis=1) <= 1)
        return np.where(near, -10.0 * d.sum(axis=1), 1e9), np.full_like(x, -10.0)

    monkeypatch.setattr(garch, "losses", cliff)
    found, converged, status = garch.maximise(r, start)
    assert not converged and status.startswith("stopped") and math.isclose(found.alpha, start.alpha, rel_tol=1e-6)
    out = garch.fit(simulated(200), CONFIG, False, lambda r, _: garch.maximise(r, start))
    assert out.state is None and out.retry_used and out.error_code == "MODEL_FIT_FAILED"


def test_a_flat_likelihood_converges_where_it_starts(monkeypatch):
    start = garch.Parameters(0.05, 0.05, 0.9)
    monkeypatch.setattr(garch, "losses", lambda r, x: (np.ones(len(x)), np.zeros_like(x)))
    found, converged, _ = garch.maximise(simulated(100), start)
    assert converged and math.isclose(found.beta, start.beta, rel_tol=1e-9)


@pytest.mark.parametrize("student", [False, True])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_fits_of_white_noise_reach_the_best_of_a_grid(seed, student):
    r = np.random.default_rng(seed).normal(0, 0.01, 250)
    got = garch.fit(r, Garch(250, 20), student)
    assert got.retry_used in (False, True) and got.parameters is not None
    scaled, v = r * 100, float(np.var(r * 100))
    grid = [garch.Parameters(v * (1 - q) * f, q * a, q * (1 - a), nu) for q in (0.01, 0.3, 0.6, 0.9, 0.98, 0.999) for a in (1e-6, 0.02, 0.1, 0.3) for f in (0.8, 1.0, 1.2) for nu in ((5.0, 8.0, 30.0, 300.0) if student else (None,))]
    best = max(garch.log_likelihood(scaled, p) for p in grid)
    assert not got.converged or garch.log_likelihood(scaled, got.parameters) >= best - 0.05


def test_the_package_exports_its_entry_points():
    import riskloom

    assert all(getattr(riskloom, name) is not None for name in riskloom.__all__)
    with pytest.raises(AttributeError):
        riskloom.nothing
