"""Registered queries against DuckDB on the smallest tables, and a stream against its batch."""

import glob
import math
import os
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F
from test_models import panel_of

import __spark_entry__ as entry
from riskloom.operators import models
from riskloom.plans import queries
from riskloom.streaming.recursive import ewma_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    con.execute(queries.SQL[name])
    columns = [d[0] for d in con.description]
    want = con.fetchall()
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple("" if v is None else repr(v) for v in row)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_garch_queries_have_outcomes(spark):
    fits, forecasts = queries.garch_fits(spark, DATA), queries.garch_forecasts(spark, DATA)
    assert fits.count() > 0 and {r.status for r in forecasts.select("status").distinct().collect()} <= {"ok", "failed"}
    assert forecasts.where("status = 'failed' AND (variance IS NOT NULL OR error_code IS NULL)").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    values = [0.01 * math.sin(i) + 0.001 for i in range(60)]
    panel = panel_of(spark, {"A": values, "B": [2 * v for v in values]})
    for part, (low, high) in enumerate(((0, 25), (25, 60))):
        panel.where(f"pos >= {low} AND pos < {high}").select("series_id", "date", "simple_return").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema("series_id string, date date, simple_return double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = ewma_stream(source, 0.94, 20).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {(r.series_id, r.date): r.variance for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    dates = {(r.series_id, r.pos): r.date for r in panel.collect()}
    want = {(r.series_id, dates[r.series_id, r.pos]): r.variance for r in models.ewma_path(panel, 0.94, 20).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert date(2020, 1, 28) in {d for _, d in got}


def test_a_row_a_date_equals_the_join(spark):
    """Forecasts with what happened from one pass over the panel: the rows and pairs of the
    join, without a join by date and with the sorted windows computed once."""
    from riskloom.operators import evaluation
    from riskloom.plans import runner
    from riskloom.plans.panels import PROFILE

    values = {"A": 1700, "SHORT": 80, "TINY": 30, "LATE": 150}
    panel = panel_of(spark, {k: [0.01 * math.sin(i * (1 + j)) + 0.001 * (i % 7) for i in range(n)] for j, (k, n) in enumerate(values.items())})
    flat = panel_of(spark, {"FLAT": [0.02 * (i < 20) for i in range(1700)]})  # its trailing variance comes to nothing
    panel = panel.unionByName(flat).withColumn("date", F.date_add(F.lit("1996-01-01").cast("date"), F.col("pos"))).cache()
    found = runner.benchmarks_and_ewma(panel, PROFILE, "0")
    rows, dates = evaluation.joined(found.forecasts, found.realizations), runner.by_date(panel, PROFILE)
    columns = [*evaluation.KEY, "model_id", "period", "simple_return", "squared_return", "loss", *runner.VALUES, "status", "error_code"]
    told = lambda df, names: sorted(map(repr, df.select(*[F.round(c, 12).alias(c) if t == "double" else c for c, t in df.select(*names).dtypes]).collect()))
    got, want = told(evaluation.rows_of(dates), columns), told(rows, columns)
    assert got == want and any("'failed'" in r for r in got)
    pairs = evaluation.pairs_of(dates)
    wide = evaluation.all_pairs(evaluation.variance_observations(rows), evaluation.quantile_observations(rows))
    assert told(pairs, wide.columns) == told(wide, wide.columns) and pairs.count() > 0
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "target_date" not in "".join(line for line in plan.splitlines() if "Join " in line)
