"""Evaluation of forecasts: availability, proper scores, coverage tests, paired comparisons.

All tables come from two scored tables (a row per forecast and metric), which callers may
cache; groupings by series and over all series (`ALL`, pooled over observations) are grouping
sets of one aggregation.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import Config
from riskloom.errors import fail
from riskloom.functions import scoring
from riskloom.functions.special import chi_square_1
from riskloom.operators import models as m
from riskloom.session import importable

# Table columns, period and series names, metric names.
KEY = ("series_id", "forecast_origin", "target_date")
PERIODS = ("validation", "test")
ALL = "ALL"
RESULT = ("experiment_id", "period", "series_id", "model_id", "metric", "observation_count", "value")
QUANTILE_SCORES = (*RESULT, "confidence_level", "tail_probability")
COVERAGE = (*QUANTILE_SCORES, "status")
COMPARISONS = (*RESULT, "benchmark_model_id", "paired_count", "effect_direction", "interval_lower", "interval_upper", "median_difference", "fraction_below_zero", "bootstrap_resamples", "block_length", "random_seed", "confidence_level")
BREAKDOWNS = (*RESULT, "period_start", "period_end")
COUNTS = (("valid_forecast_count", "ok"), ("failed_forecast_count", "failed"), ("unavailable_forecast_count", "unavailable"))
COVERAGE_METRICS = (
    "expected_exception_probability", "exception_count", "exception_rate", "longest_exception_cluster", "n00", "n01", "n10", "n11", "kupiec_lr", "kupiec_p_value",
    "christoffersen_independence_lr", "christoffersen_independence_p_value", "conditional_coverage_lr", "conditional_coverage_p_value",
)
SORT = ("period", "series_id", "model_id", "metric", "confidence_level", "benchmark_model_id")


def ordered(table: DataFrame) -> DataFrame:
    return table.orderBy(*[c for c in SORT if c in table.columns])


def joined(forecasts: DataFrame, realizations: DataFrame) -> DataFrame:
    """Forecasts of evaluated periods with what happened. A forecast without a realization is
    an error when the row is read."""
    happened = realizations.select(*KEY, "simple_return", "squared_return", "loss", "period", F.lit(True).alias("found"))
    rows = forecasts.join(happened, list(KEY), "left")
    missing = F.raise_error(F.lit("WINDOW_ALIGNMENT_ERROR: a forecast has no realization")).cast("string")
    return rows.withColumn("period", F.when(F.col("found"), F.col("period")).otherwise(missing)).drop("found").where(F.col("period").isin(*PERIODS))


def _valid(rows: DataFrame, models: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("model_id").isin(*models) & (F.col("status") == "ok"))


def variance_observations(rows: DataFrame) -> DataFrame:
    """Three scores for each valid variance forecast."""
    v, r2 = F.col("variance"), F.col("squared_return")
    bad = F.raise_error(F.lit("NONPOSITIVE_VARIANCE: a valid forecast needs a finite positive variance")).cast("double")
    v = F.when(scoring.finite(v) & (v > 0), v).otherwise(bad)
    scores = {"qlike": scoring.qlike(v, r2), "squared_error": scoring.squared_error(v, r2), "absolute_error": scoring.absolute_error(v, r2)}
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), s.alias("score")) for k, s in scores.items()]))
    return _valid(rows, m.VARIANCE_MODELS).select("period", "model_id", *KEY, items.alias("x")).select("period", "model_id", *KEY, "x.metric", "x.score")


def quantile_observations(rows: DataFrame) -> DataFrame:
    """A score and an exception flag for each valid forecast and tail."""
    items = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(level).alias("confidence_level"),
            F.lit(tail).alias("tail_probability"),
            scoring.pinball(F.col(q), F.col("simple_return"), tail).alias("score"),
            scoring.exception(F.col("loss"), F.col(var)).alias("exception"),
        )
        for metric, q, var, level, tail in scoring.TAILS
    ]
    return _valid(rows, m.QUANTILE_MODELS).select("period", "model_id", *KEY, F.explode(F.array(*items)).alias("x")).select("period", "model_id", *KEY, "x.*")


def with_all(rows: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by keys and series, and by keys over all series, in one pass."""
    grouped = rows.groupingSets([["series_id", *keys], keys], "series_id", *keys).agg(*aggregates, F.grouping("series_id").alias("_all"))
    return grouped.withColumn("series_id", F.when(F.col("_all") == 1, ALL).otherwise(F.col("series_id"))).drop("_all")


def _long(table: DataFrame, keys: list[str], values: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    items = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), *[c(k).alias(n) for n, c in (extra or {}).items()]) for k, v in values.items()]
    return table.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")


def _is(status: str) -> Column:
    return F.sum((F.col("status") == status).cast("bigint"))


def availability(rows: DataFrame, experiment_id: str) -> DataFrame:
    table = with_all(rows, ["period", "model_id"], [F.count(F.lit(1)).alias("observation_count"), *[_is(s).alias(k) for k, s in COUNTS]])
    values = {"total_eligible_target_dates": F.col("observation_count")} | {k: F.col(k) for k, _ in COUNTS}
    long = _long(table, ["period", "series_id", "model_id", "observation_count"], values)
    return long.withColumn("experiment_id", F.lit(experiment_id)).select(*RESULT)


def score_table(observations: DataFrame, experiment_id: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Mean scores; over all series the mean is pooled over observations."""
    table = with_all(observations, ["period", "model_id", "metric", *extra], [F.count(F.lit(1)).alias("observation_count"), F.avg("score").alias("value")])
    return table.withColumn("experiment_id", F.lit(experiment_id)).select(*RESULT, *extra)


#: Days whose exceptions one group folds.
FOLD_DAYS = 256
_COUNTED = ("n", "x", "n00", "n01", "n10", "n11", "lead", "tail", "best")


def _merged(a: Column, b: Column) -> Column:
    """What two neighbouring stretches of exceptions tell together: counts, transitions, the
    runs of exceptions at both ends and the longest one. Associative, with an empty stretch as
    its neutral element."""
    step = lambda i, j: F.coalesce(((a["last"] == i) & (b["first"] == j)).cast("bigint"), F.lit(0).cast("bigint"))
    parts = {k: a[k] + b[k] for k in ("n", "x")} | {f"n{i}{j}": a[f"n{i}{j}"] + b[f"n{i}{j}"] + step(i, j) for i in (0, 1) for j in (0, 1)}
    parts["lead"] = F.when(a["x"] == a["n"], a["n"] + b["lead"]).otherwise(a["lead"])
    parts["tail"] = F.when(b["x"] == b["n"], b["n"] + a["tail"]).otherwise(b["tail"])
    parts["best"] = F.greatest(a["best"], b["best"], a["tail"] + b["lead"])
    ends = {"first": F.coalesce(a["first"], b["first"]), "last": F.coalesce(b["last"], a["last"])}
    return F.struct(*[v.alias(k) for k, v in (parts | ends).items()])


def _stretch(now: Column | None) -> Column:
    """The stretch of one observation (1: an exception), or the empty one."""
    one = {k: now if k in ("x", "lead", "tail", "best") else F.lit(1) if k == "n" else F.lit(0) for k in _COUNTED} if now is not None else {k: F.lit(0) for k in _COUNTED}
    ends = {k: F.lit(None) if now is None else now for k in ("first", "last")}
    return F.struct(*[v.cast("bigint").alias(k) for k, v in (one | ends).items()])


def exception_counts(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: observations, exceptions, transitions between successive observations (in the
    order of target dates) and the longest run of exceptions. Stretches of FOLD_DAYS days are
    folded apart and then merged in order, so a long series is spread over tasks."""
    day = F.unix_date("target_date")
    rows = observations.select(*keys, F.floor(day / FOLD_DAYS).alias("_stretch"), F.struct(day.alias("day"), F.col("exception").cast("bigint").alias("now")).alias("row"))
    stretches = rows.groupBy(*keys, "_stretch").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    folded = stretches.select(*keys, F.struct("_stretch", F.aggregate("rows", _stretch(None), lambda a, r: _merged(a, _stretch(r["now"]))).alias("told")).alias("part"))
    whole = folded.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    told = whole.select(*keys, F.aggregate("parts", _stretch(None), lambda a, p: _merged(a, p["told"])).alias("t"))
    names = {"observation_count": "n", "exception_count": "x", **{f"n{i}{j}": f"n{i}{j}" for i in (0, 1) for j in (0, 1)}, "longest_exception_cluster": "best"}
    return told.select(*keys, *[F.col(f"t.{v}").alias(k) for k, v in names.items()])


def coverage_wide(counts: DataFrame) -> DataFrame:
    """Kupiec, Christoffersen and conditional coverage statistics from counts and
    tail_probability; those that need transitions are null where any kind is missing."""
    importable(counts.sparkSession)
    x, n, p = F.col("exception_count").cast("double"), F.col("observation_count").cast("double"), F.col("tail_probability")
    n00, n01, n10, n11 = (F.col(f"n{a}{b}").cast("double") for a in (0, 1) for b in (0, 1))
    enough = (n00 > 0) & (n01 > 0) & (n10 > 0) & (n11 > 0)
    total, events = n00 + n01 + n10 + n11, n01 + n11
    one = scoring.bernoulli(events, total, events / total)
    two = scoring.bernoulli(n01, n00 + n01, n01 / (n00 + n01)) + scoring.bernoulli(n11, n10 + n11, n11 / (n10 + n11))
    rows = counts.withColumn("expected_exception_probability", p).withColumn("exception_rate", x / n)
    rows = rows.withColumn("kupiec_lr", scoring.likelihood_ratio(scoring.bernoulli(x, n, p), scoring.bernoulli(x, n, x / n)))
    rows = rows.withColumn("christoffersen_independence_lr", F.when(enough, scoring.likelihood_ratio(one, two)))
    rows = rows.withColumn("conditional_coverage_lr", F.col("kupiec_lr") + F.col("christoffersen_independence_lr"))
    rows = rows.withColumn("christoffersen_status", F.when(enough, "ok").otherwise("insufficient_events"))
    rows = rows.withColumn("kupiec_p_value", chi_square_1("kupiec_lr")).withColumn("christoffersen_independence_p_value", chi_square_1("christoffersen_independence_lr"))
    return rows.withColumn("conditional_coverage_p_value", F.exp(-F.col("conditional_coverage_lr") / 2))


def coverage_table(observations: DataFrame, experiment_id: str) -> DataFrame:
    keys = ["period", "series_id", "model_id", "confidence_level", "tail_probability"]
    wide = coverage_wide(exception_counts(observations, keys))
    status = lambda k: F.col("christoffersen_status") if k.startswith(("christoffersen", "conditional_coverage")) else F.lit("ok")
    long = _long(wide, [*keys, "observation_count"], {k: F.col(k) for k in COVERAGE_METRICS}, {"status": status})
    return long.withColumn("experiment_id", F.lit(experiment_id)).select(*COVERAGE)


def paired_differences(observations: DataFrame, benchmark: str) -> DataFrame:
    """Candidate score less benchmark score on the dates that both have (pair by pair). The
    models of one date meet in one window, so the observations are dealt out once."""
    date_ = Window.partitionBy(*KEY, "period", "metric")
    base = F.max(F.when(F.col("model_id") == benchmark, F.col("score"))).over(date_)
    rows = observations.withColumn("benchmark_score", base).where(F.col("model_id").isin(*m.CANDIDATES) & F.col("benchmark_score").isNotNull())
    return rows.select("period", "model_id", F.lit(benchmark).alias("benchmark_model_id"), "metric", *KEY, (F.col("score") - F.col("benchmark_score")).alias("difference"))


def all_pairs(variance: DataFrame, quantile: DataFrame) -> DataFrame:
    return paired_differences(variance, m.HISTORICAL_VARIANCE).unionByName(paired_differences(quantile.select(*variance.columns), m.HISTORICAL_SIMULATION))


MODELS_BY_DATE = (m.HISTORICAL_VARIANCE, m.HISTORICAL_SIMULATION, m.EWMA)


def rows_of(dates: DataFrame) -> DataFrame:
    """The rows of `joined` from a row a date (runner.by_date), without ids."""
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("model_id"), F.col(k).alias("v")) for k in MODELS_BY_DATE]))
    return dates.select(*KEY, "period", "simple_return", "squared_return", "loss", told.alias("x")).where("x.v IS NOT NULL").select(*KEY, "period", "simple_return", "squared_return", "loss", "x.model_id", "x.v.*")


def pairs_of(dates: DataFrame, candidate: str = m.EWMA) -> DataFrame:
    """all_pairs of the candidate from a row a date (runner.by_date): both models of a pair are
    in the row, so nothing is dealt out."""
    r2, r = F.col("squared_return"), F.col("simple_return")
    scores = {"qlike": scoring.qlike, "squared_error": scoring.squared_error, "absolute_error": scoring.absolute_error}
    checked = lambda k: F.when(F.col(f"{k}.status") == "ok", F.col(f"{k}.variance"))
    valid = lambda k, c: F.when(F.col(f"{k}.status") == "ok", F.col(f"{k}.{c}"))
    kinds = [(k, m.HISTORICAL_VARIANCE, f(checked(candidate), r2) - f(checked(m.HISTORICAL_VARIANCE), r2)) for k, f in scores.items()]
    kinds += [(k, m.HISTORICAL_SIMULATION, scoring.pinball(valid(candidate, q), r, tail) - scoring.pinball(valid(m.HISTORICAL_SIMULATION, q), r, tail)) for k, q, _, _, tail in scoring.TAILS]
    items = F.explode(F.array(*[F.struct(F.lit(b).alias("benchmark_model_id"), F.lit(k).alias("metric"), d.alias("difference")) for k, b, d in kinds]))
    pairs = dates.select("period", F.lit(candidate).alias("model_id"), *KEY, items.alias("x")).where("x.difference IS NOT NULL")
    return pairs.select("period", "model_id", "x.benchmark_model_id", "x.metric", *KEY, "x.difference")


def direction(mean: Column) -> Column:
    return F.when(mean.isNull(), "unavailable").when(mean < 0, "candidate_better").when(mean > 0, "benchmark_better").otherwise("tie")


#: Accuracy of the sketch that brackets a median: one rank in so many.
SKETCH = 10_000


def exact_medians(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, n, mean, median): exact medians without a buffer of all values. A mergeable sketch
    gives two values that hold the middle ranks between them, some n / SKETCH ranks apart; then
    those between are counted by value and those below by number. Keys are few: the brackets
    are broadcast."""
    x, off = F.col(column), 5 / SKETCH
    told = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile_approx(x, [0.5 - off, 0.5 + off], SKETCH).alias("between"))
    told = F.broadcast(told)  # the same table both times, so it is made once
    placed = rows.join(told, keys).where(x <= F.col("between")[1])
    counts = placed.groupBy(*keys, F.when(x >= F.col("between")[0], x).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()))
    ranked = counts.withColumn("upto", upto).join(told, keys)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    middle = [F.max(F.when(holds(F.expr(e)), F.col("value"))) for e in ("(n - 1) div 2", "n div 2")]
    found = ranked.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), ((middle[0] + middle[1]) / 2).alias("median"))
    return found.withColumn("median", F.coalesce("median", F.raise_error(F.lit("a bracket misses its median")).cast("double")))


def point_estimates(pairs: DataFrame) -> DataFrame:
    """Count, mean, median and direction of the differences, by series and pooled."""
    keys = ["period", "model_id", "benchmark_model_id", "metric"]
    single = pairs.groupBy("series_id", *keys).agg(F.count(F.lit(1)).alias("paired_count"), F.avg("difference").alias("value"), F.median("difference").alias("median_difference"))
    pooled = exact_medians(pairs, keys, "difference").select(F.lit(ALL).alias("series_id"), *keys, F.col("n").alias("paired_count"), F.col("mean").alias("value"), F.col("median").alias("median_difference"))
    return single.unionByName(pooled).withColumn("effect_direction", direction(F.col("value")))


def resampled_sums(values: np.ndarray, block: int, resamples: int, rng: np.random.Generator) -> np.ndarray:
    """Sums of moving-block resamples of one series; each resample has as many values as it."""
    n = len(values)
    if not n or block < 1 or resamples < 1:
        raise fail("WINDOW_ALIGNMENT_ERROR", "The bootstrap needs non-empty groups and positive controls.")
    if not np.isfinite(values).all():
        raise fail("WINDOW_ALIGNMENT_ERROR", "A difference is not finite.")
    b, sums, at = min(block, n), np.empty(resamples), 0
    before = np.concatenate([[0.0], np.cumsum(values)])  # a block's sum is a difference of two
    for starts in drawn_starts(n, block, resamples, rng):
        ends = starts + b
        ends[:, -1] -= starts.shape[1] * b - n
        sums[at : at + len(starts)] = (before[ends] - before[starts]).sum(axis=1)
        at += len(starts)
    return sums


#: Block positions drawn at once.
DRAWN = 1 << 20


def drawn_starts(n: int, block: int, resamples: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """First positions of the blocks of each resample, some resamples at a time. They depend on
    the length only; the stream does not depend on how many are drawn at once."""
    b = min(block, n)
    blocks = math.ceil(n / b)
    step = max(1, DRAWN // blocks)
    for at in range(0, resamples, step):
        yield rng.integers(0, n - b + 1, size=(min(step, resamples - at), blocks))


def block_means(groups: list[np.ndarray], block: int, resamples: int, seed: int) -> np.ndarray:
    """Means of moving-block resamples, with one stream of draws over all groups in order."""
    if not groups:
        raise fail("WINDOW_ALIGNMENT_ERROR", "The bootstrap needs non-empty groups and positive controls.")
    rng = np.random.default_rng(seed)
    return sum(resampled_sums(np.asarray(g, float), block, resamples, rng) for g in groups) / sum(map(len, groups))


def resamples_by_series(pairs: DataFrame, config: Config) -> DataFrame:
    """Rows (period, model_id, benchmark_model_id, metric, series_id, at, total, n): the sum of
    resample `at` of n differences, for each series with its own stream and, under ALL, for the
    same series as its part of the pooled stream. A task has one series of one comparison. The
    pooled stream runs over the series in name order; where it stands before each of them
    follows from the lengths alone, so it is found on a table of a row a series, once for all
    comparisons of the same lengths."""
    importable(pairs.sparkSession)
    e, seed = config.evaluation, config.experiment.random_seed
    kind = ["period", "model_id", "benchmark_model_id", "metric"]

    def states(rows: pd.DataFrame) -> pd.DataFrame:
        rows, rng, out = rows.sort_values("series_id", kind="stable"), np.random.default_rng(seed), []
        for n in rows["n"]:
            out.append(json.dumps(rng.bit_generator.state))
            for _ in drawn_starts(int(n), e.bootstrap_block_length, e.bootstrap_resamples, rng):
                pass
        return rows.assign(state=out)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        values, first = rows.sort_values("target_date", kind="stable")["difference"].to_numpy(float), rows.iloc[0]
        pooled = np.random.default_rng(seed)
        pooled.bit_generator.state = json.loads(first["state"])
        parts = []
        for series, rng in ((first["series_id"], np.random.default_rng(seed)), (ALL, pooled)):
            sums = resampled_sums(values, e.bootstrap_block_length, e.bootstrap_resamples, rng)
            parts.append(pd.DataFrame({**{k: first[k] for k in kind}, "series_id": series, "at": np.arange(len(sums)), "total": sums, "n": len(values)}))
        return pd.concat(parts)

    text = ", ".join(f"{k} string" for k in [*kind, "series_id"])
    sizes = pairs.groupBy(*kind, "series_id").agg(F.count(F.lit(1)).alias("n"))
    # Comparisons over the same series with the same lengths share one stream: it is run once.
    alike = [F.count(F.lit(1)), *[F.sum(F.xxhash64("series_id", "n", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1)]]
    sizes = sizes.withColumn("lengths", F.concat_ws(":", *[c.over(Window.partitionBy(*kind)) for c in alike]))
    runs = sizes.select("lengths", "series_id", "n").distinct().groupBy("lengths").applyInPandas(states, "lengths string, series_id string, n bigint, state string").drop("n")
    known = sizes.select(*kind, "series_id", "lengths").join(runs, ["lengths", "series_id"]).drop("lengths")
    rows = pairs.select(*kind, "series_id", "target_date", "difference").join(known, [*kind, "series_id"])
    return rows.groupBy(*kind, "series_id").applyInPandas(one, f"{text}, at int, total double, n bigint")


def intervals(pairs: DataFrame, config: Config) -> DataFrame:
    """Bootstrap interval of the mean difference for each comparison, by series and pooled."""
    tail = (1 - config.evaluation.bootstrap_confidence) / 2
    keys = ["period", "model_id", "benchmark_model_id", "metric", "series_id"]
    means = resamples_by_series(pairs, config).groupBy(*keys, "at").agg((F.sum("total") / F.sum("n")).alias("mean"))
    ends = {"interval_lower": F.percentile("mean", F.lit(tail)), "interval_upper": F.percentile("mean", F.lit(1 - tail)), "fraction_below_zero": F.avg((F.col("mean") < 0).cast("double"))}
    return means.groupBy(*keys).agg(*[v.alias(k) for k, v in ends.items()])


def comparison_grid(series: DataFrame) -> DataFrame:
    """Every comparison that the table must hold: series (with ALL) by candidate, metric, period."""
    kinds = [(metric, m.HISTORICAL_VARIANCE) for metric in scoring.VARIANCE_METRICS] + [(t[0], m.HISTORICAL_SIMULATION) for t in scoring.TAILS]
    cells = [F.struct(F.lit(p).alias("period"), F.lit(c).alias("model_id"), F.lit(b).alias("benchmark_model_id"), F.lit(k).alias("metric")) for p in PERIODS for c in m.CANDIDATES for k, b in kinds]
    return series.select("series_id", F.explode(F.array(*cells)).alias("x")).select("series_id", "x.*")


def comparisons(variance: DataFrame, quantile: DataFrame, config: Config) -> DataFrame:
    spark = variance.sparkSession
    pairs = all_pairs(variance, quantile)
    everyone = spark.createDataFrame([(ALL,)], "series_id string")
    series = variance.select("series_id").union(quantile.select("series_id")).distinct().union(everyone)
    on = ["period", "model_id", "benchmark_model_id", "metric", "series_id"]
    e = config.evaluation
    rows = comparison_grid(series).join(point_estimates(pairs), on, "left").join(intervals(pairs, config), on, "left")
    fixed = {"experiment_id": config.experiment.experiment_id, "bootstrap_resamples": e.bootstrap_resamples, "block_length": e.bootstrap_block_length, "random_seed": config.experiment.random_seed}
    rows = rows.withColumn("paired_count", F.coalesce("paired_count", F.lit(0).cast("bigint"))).withColumn("effect_direction", F.coalesce("effect_direction", F.lit("unavailable")))
    rows = rows.withColumn("observation_count", F.col("paired_count")).withColumns({k: F.lit(v).cast("string" if k == "experiment_id" else "bigint") for k, v in fixed.items()})
    return rows.withColumn("confidence_level", F.lit(e.bootstrap_confidence)).select(*COMPARISONS)


def test_years(config: Config) -> list[int]:
    """The years of the test period: those that have a breakdown."""
    return [*range(config.periods.test_start.year, config.periods.test_end.year + 1)]


def breakdowns(rows: DataFrame, variance: DataFrame, quantile: DataFrame, config: Config) -> DataFrame:
    """Counts, mean scores and exception rates of each year of the test period."""
    years = test_years(config)

    def yearly(table: DataFrame) -> DataFrame:
        return table.where(F.col("period") == "test").withColumn("year", F.year("target_date")).where(F.col("year").isin(*years))

    n = F.count(F.lit(1)).alias("observation_count")
    counted = with_all(yearly(rows), ["year", "model_id"], [n, *[_is(s).alias(k) for k, s in COUNTS]])
    counted = _long(counted, ["year", "series_id", "model_id", "observation_count"], {k: F.col(k) for k, _ in COUNTS})
    scored = with_all(yearly(variance).select("series_id", "year", "model_id", "metric", "score").unionByName(yearly(quantile).select("series_id", "year", "model_id", "metric", "score")), ["year", "model_id", "metric"], [n, F.avg("score").alias("value")])
    rates = with_all(yearly(quantile), ["year", "model_id", "metric"], [n, F.avg(F.col("exception").cast("double")).alias("value")])
    rates = rates.withColumn("metric", F.replace("metric", F.lit("pinball_loss"), F.lit("exception_rate")))
    out = counted.unionByName(scored).unionByName(rates)
    text = F.col("year").cast("string")
    return out.withColumns({"experiment_id": F.lit(config.experiment.experiment_id), "period": F.concat(F.lit("test_"), text), "period_start": F.concat(text, F.lit("-01-01")), "period_end": F.concat(text, F.lit("-12-31"))}).select(*BREAKDOWNS)


def evaluate(forecasts: DataFrame, realizations: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The six evaluation tables from saved forecasts and realizations."""
    name = config.experiment.experiment_id
    rows = joined(forecasts, realizations).cache()
    variance, quantile = variance_observations(rows).cache(), quantile_observations(rows).cache()
    return {
        "forecast_availability": availability(rows, name),
        "variance_scores": score_table(variance, name),
        "quantile_scores": score_table(quantile, name, ("confidence_level", "tail_probability")),
        "coverage_tests": coverage_table(quantile, name),
        "bootstrap_comparisons": comparisons(variance, quantile, config),
        "period_breakdowns": breakdowns(rows, variance, quantile, config),
    }
