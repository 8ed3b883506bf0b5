from datetime import date

import pytest
from pyspark.sql import functions as F
from test_models import panel_of

from riskloom.config import Periods
from riskloom.errors import BY_CODE
from riskloom.operators import panel, windows
from riskloom.sources import fixture

DAYS = Periods(date(2020, 1, 1), date(2020, 1, 31), date(2020, 2, 10), date(2020, 2, 28), date(2020, 3, 2), date(2020, 12, 31))


@pytest.fixture(scope="module")
def rows(spark):
    return panel_of(spark, {"A": [0.01] * 60, "B": [0.02] * 60})


def test_trailing(rows):
    got = windows.trailing_windows(rows, 5, DAYS, "m").where("series_id = 'A'").orderBy("forecast_origin").collect()
    assert all(r.forecast_origin < r.target_date and r.train_end == r.forecast_origin and r.train_observation_count == 5 for r in got)
    assert got[0].forecast_origin == date(2020, 1, 7)
    # Targets in the gap have no window; a window may begin in the period before.
    targets = [r.target_date for r in got]
    assert not any(date(2020, 2, 1) <= t < date(2020, 2, 10) for t in targets)
    first = next(r for r in got if r.period == "validation")
    assert first.target_date == date(2020, 2, 10) and first.train_start < date(2020, 2, 10)
    assert not any(r.scheduled_refit for r in got)


def test_expanding(rows):
    got = windows.expanding_windows(rows, 5, DAYS, "m").where("series_id = 'B'").orderBy("forecast_origin").collect()
    assert {r.train_start for r in got} == {date(2020, 1, 1)} and got[0].train_observation_count == 5 and got[-1].train_observation_count == 59


def test_refits_count_eligible_origins_only(rows):
    got = windows.refit_windows(rows, 5, 7, DAYS, ["m"]).where("series_id = 'A'").orderBy("forecast_origin").collect()
    assert [i for i, r in enumerate(got) if r.scheduled_refit] == list(range(0, len(got), 7))
    assert [r.fit_block for r in got] == [i // 7 for i in range(len(got))]


def test_small_windows_are_refused_and_short_series_have_none(rows):
    with pytest.raises(BY_CODE["INSUFFICIENT_HISTORY"]):
        windows.trailing_windows(rows, 1, DAYS, "m")
    assert windows.trailing_windows(rows, 60, DAYS, "m").count() == 0


def test_realizations(rows):
    got = windows.realizations(rows, 4, DAYS).where("series_id = 'B'").collect()
    assert all((r.simple_return, r.squared_return, r.loss) == (0.02, 0.02 * 0.02, -0.02) for r in got)
    assert min(r.forecast_origin for r in got) == date(2020, 1, 7)


def test_later_rows_leave_earlier_windows_alone(spark, rows):
    few = windows.trailing_windows(rows.where(F.col("pos") < 40), 5, DAYS, "m")
    assert few.join(windows.trailing_windows(rows, 5, DAYS, "m"), few.columns, "left_anti").count() == 0


def test_index_checks(spark):
    index = lambda days: spark.createDataFrame([(i, date(2020, 1, d)) for i, d in enumerate(days)], "pos int, date date")
    panel.check_index(index([1, 2, 3]))
    for days, code in (([], "WINDOW_ALIGNMENT_ERROR"), ([1, 2, 2], "INPUT_DATE_DUPLICATE"), ([2, 1], "INPUT_DATE_UNSORTED")):
        with pytest.raises(BY_CODE[code]):
            panel.check_index(index(days))


def test_fixture_and_proxy(spark):
    wide = panel.with_proxy(fixture.returns(spark), fixture.WEIGHTS, fixture.PROXY)
    first = wide.orderBy("date").first()
    assert wide.count() == 4957 and first.date == date(2007, 1, 2)
    assert [round(first[c], 10) for c in ("SPY", "IEF", "GLD", "FIXTURE_PROXY")] == [-0.008, -0.0045, -0.0073333333, -0.0068833333]
    long = panel.to_long(wide)
    assert long.count() == 4 * 4957 and long.where("series_id = 'GLD'").first().series_pos == 2
    assert panel.to_wide(long, ["SPY", "IEF", "GLD"]).orderBy("date").first().SPY == first.SPY
    for weights in ({"IEF": 0.5, "SPY": 0.5, "GLD": 0.0}, {"SPY": 0.5, "IEF": 0.4, "GLD": 0.0}):
        with pytest.raises(BY_CODE["CONFIG_INVALID"]):
            panel.with_proxy(fixture.returns(spark), weights, "P")


def test_alignment_keeps_common_dates_only(spark):
    days = [date(2020, 1, d) for d in (1, 2, 3)]
    levels = [("A", days[0], 1.0), ("A", days[1], 2.0), ("A", days[2], 3.0), ("B", days[0], 10.0), ("B", days[2], 5.0)]
    got = {r.series_id: (r.date, r.simple_return) for r in panel.aligned_returns(spark.createDataFrame(levels, "series_id string, date date, level double"), ["A", "B"]).collect()}
    assert got == {"A": (days[2], 2.0), "B": (days[2], -0.5)}


def test_fixture_query_keeps_the_whole_calendar(spark):
    """All business days stay, whatever orders there are, and orders past the end run on."""
    n = 4957
    keys = spark.createDataFrame([(0,), (3,), (n,), (n + 18,), (None,)], "k bigint")
    got = {(r.k, r.date): tuple(r)[2:] for r in fixture.returns_at(keys, "k").collect()}
    days = {r.date: tuple(r)[1:] for r in fixture.returns(spark).collect()}
    firsts = sorted(days)
    assert len(days) == n and {d for _, d in got if d} == set(days) and len(got) == n + 3
    assert all(v == days[d] for (k, d), v in got.items() if d and (k is None or k < n))
    assert got[0, firsts[0]] == days[firsts[0]] and got[n + 18, firsts[18]][0] == ((n + 18) % 17 - 8) / 1000.0 and got[None, None] == (None, None, None)
