"""The report: Markdown and figures from an experiment's saved tables, and from nothing else.

Aggregation stays in Spark; only report-sized results reach the driver. The saved tables are
hashed before and after, and the report's files move in together.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.errors import fail
from riskloom.operators import evaluation, models, reporting
from riskloom.plans import experiment, figures
from riskloom.sources import artifacts, run
from riskloom.sources.store import Place, load_json, place_of

# Titles of the report's sections, in order.
SECTIONS = (
    "Direct answer", "Forecasts through time", "95% VaR through time", "Rolling model advantage", "Final-test variance comparison", "Final-test 95% VaR comparison", "Final-test results by series",
    "Validation results", "Forecast availability", "VaR calibration by series", "Fit diagnostics", "Run identity and data lineage", "Method and traceability", "Limitations",
)
FIGURES = tuple(f"figures/{n}.svg" for n in ("volatility_history", "exception_history", "rolling_advantage", "qlike_comparison", "pinball_comparison", "availability", "calibration", "series_comparisons"))
FILES = (experiment.REPORT, *FIGURES)


@dataclass(frozen=True)
class Report:
    path: Place
    reused: bool


def number(value: Any) -> str:
    return "n/a" if value is None or value != value else f"{value:.6g}" if isinstance(value, float) else str(value)


def markdown(rows: list[Any], columns: list[str]) -> str:
    if not rows:
        return "No rows."
    body = ["| " + " | ".join(number(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *body])


def _compared(tables: dict[str, DataFrame], period: str, metric: str) -> list[Any]:
    return reporting.comparison_rows(tables["bootstrap_comparisons"], period, metric).collect()


_COMPARE = ["model_id", "paired_count", "value", "interval_lower", "interval_upper", "median_difference", "fraction_below_zero", "effect_direction"]


def differences(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Daily differences for the rolling comparison, for variance and for the 95 % VaR."""
    rows = evaluation.joined(tables["forecasts"], tables["realizations"])
    variance, quantile = evaluation.variance_observations(rows), evaluation.quantile_observations(rows)
    pairs = evaluation.all_pairs(variance, quantile)
    return pairs.where("metric = 'qlike'"), pairs.where("metric = 'pinball_loss_0_05'")


def figure_tables(tables: dict[str, DataFrame], window: int) -> dict[str, DataFrame]:
    """The data behind each figure."""
    f, r, b = tables["forecasts"], tables["realizations"], tables["bootstrap_comparisons"]
    q, p = differences(tables)
    return {
        "volatility_history": reporting.volatility_history(f, r),
        "exception_history": reporting.exception_history(f, r),
        "rolling_advantage": reporting.rolling_advantage(q, window).unionByName(reporting.rolling_advantage(p, window)),
        "qlike_comparison": reporting.comparison_rows(b, "test", "qlike"),
        "pinball_comparison": reporting.comparison_rows(b, "test", "pinball_loss_0_05").withColumns({c: F.col(c) * 10_000 for c in ("value", "interval_lower", "interval_upper")}),
        "availability": reporting.availability_pivot(tables["forecast_availability"]),
        "calibration": reporting.calibration_points(tables["coverage_tests"]),
        "series_comparisons": reporting.series_comparisons(b),
    }


def series_of(identity: dict[str, Any]) -> list[str]:
    """All series of an experiment in the order of its input, the proxy last."""
    config = identity["configuration"]
    proxy = config["portfolio_proxy"]
    return [*config["upstream"]["instruments"], *([proxy["series_id"]] if proxy["enabled"] else [])]


def _told(value: Any, *path: str) -> Any:
    """A value inside nested objects, or "unavailable" where any step is missing or empty."""
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return "unavailable" if value is None or value == "" else value


def _drawn(name: str, data: DataFrame, series: list[str]) -> str:
    """Figures of daily values have a panel a series, in the given order."""
    title = name.replace("_", " ").capitalize()
    if name in ("volatility_history", "exception_history"):
        value = "volatility" if name == "volatility_history" else "loss"
        points = data.select("series_id", "model_id", F.unix_date("target_date").alias("x"), F.col(value).alias("y"))
        lines: dict[str, dict[str, list]] = {one: {} for one in series}
        for r in reporting.pixel_columns(points, ["series_id", "model_id"]).orderBy("series_id", "model_id", "x", "y").collect():
            lines.setdefault(r.series_id, {}).setdefault(r.model_id, []).append((r.x, r.y))
        return figures.stacked([figures.lines(f"{title}: {one}", lines[one], points=name == "exception_history") for one in series])
    if name == "rolling_advantage":
        points = data.where("metric = 'qlike'").select("model_id", F.unix_date("target_date").alias("x"), F.col("rolling_difference").alias("y"))
        rows = reporting.pixel_columns(points, ["model_id"]).orderBy("model_id", "x", "y").collect()
        return figures.lines(title, {k: [(r.x, r.y) for r in rows if r.model_id == k] for k in sorted({r.model_id for r in rows})})
    rows = data.collect()
    if name == "availability":
        return figures.intervals(title, [(r.model_id, r.valid_share, None, None) for r in rows])
    if name == "calibration":
        return figures.intervals(title, [(f"{r.series_id} {r.model_id} {r.confidence_level:g}", r.exception_rate - r.nominal_rate, None, None) for r in rows])
    return figures.intervals(title, [((f"{r.series_id} " if name == "series_comparisons" else "") + f"{r.model_id} {r.metric}", r.value, r.interval_lower, r.interval_upper) for r in rows])


def render(tables: dict[str, DataFrame], identity: dict[str, Any], manifest: dict[str, Any]) -> str:
    config = identity["configuration"]
    series = series_of(identity)
    confidence = f"{config['evaluation']['bootstrap_confidence'] * 100:g}%"
    winners = {m: [r.model_id for r in reporting.directions(tables["bootstrap_comparisons"], "test", m).collect()] for m in ("qlike", "pinball_loss_0_05")}
    verdicts = reporting.calibration_summary(tables["coverage_tests"], len(series)).orderBy("model_id").collect()
    say = lambda names, what, base: f"For {what}, {', '.join(names)} beat {base} with a {confidence} interval below zero." if names else f"For {what}, no candidate beat {base} with a {confidence} interval below zero."
    coverage = {level: reporting.coverage_pivot(tables["coverage_tests"], level).orderBy("series_id", "model_id").collect() for level in (0.95, 0.99)}
    per_series = reporting.series_comparisons(tables["bootstrap_comparisons"]).orderBy("metric", "series_id", "model_id").collect()
    fits = reporting.diagnostics_summary(tables["fit_diagnostics"], tables["forecasts"]).orderBy("model_id").collect()
    available = reporting.availability_pivot(tables["forecast_availability"]).orderBy("model_id").collect()
    body = {
        "Direct answer": "\n\n".join([say(winners["qlike"], "variance (QLIKE)", models.HISTORICAL_VARIANCE), say(winners["pinball_loss_0_05"], "the 95% VaR (pinball loss)", models.HISTORICAL_SIMULATION), "Calibration: " + "; ".join(f"{r.model_id} {r.verdict}" for r in verdicts) + "."]),
        "Forecasts through time": f"![Volatility]({FIGURES[0]})\n\nVolatility forecasts in percent; realized values are a noisy proxy.",
        "95% VaR through time": f"![Exceptions]({FIGURES[1]})\n\nDays whose loss was over the 95% VaR.",
        "Rolling model advantage": f"![Advantage]({FIGURES[2]})\n\nMean difference to the benchmark over {config['historical']['variance_window']} days, on days that all series have; below zero the candidate is better.",
        "Final-test variance comparison": f"![QLIKE]({FIGURES[3]})\n\n" + markdown(_compared(tables, "test", "qlike"), _COMPARE),
        "Final-test 95% VaR comparison": f"![Pinball]({FIGURES[4]})\n\n" + markdown(_compared(tables, "test", "pinball_loss_0_05"), _COMPARE),
        "Final-test results by series": f"![By series]({FIGURES[7]})\n\n" + markdown(per_series, ["series_id", "metric", *_COMPARE]),
        "Validation results": markdown(_compared(tables, "validation", "qlike") + _compared(tables, "validation", "pinball_loss_0_05"), ["metric", *_COMPARE]),
        "Forecast availability": f"![Availability]({FIGURES[5]})\n\n" + markdown(available, ["model_id", "total_eligible_target_dates", "valid_forecast_count", "failed_forecast_count", "unavailable_forecast_count"]),
        "VaR calibration by series": f"![Calibration]({FIGURES[6]})\n\n" + "\n\n".join(f"Level {level:g}\n\n" + markdown(rows, ["series_id", "model_id", *reporting.COVERAGE_COLUMNS]) for level, rows in coverage.items()),
        "Fit diagnostics": markdown(fits, ["model_id", "fits", "converged", "retries", "failed_forecasts"]),
        "Run identity and data lineage": "\n".join(
            f"- {k}: {v}"
            for k, v in (
                ("experiment", _told(identity, "experiment_id")), ("series", ", ".join(series)), ("observations", _told(identity, "dataset", "observation_count")),
                ("dates", f"{_told(identity, 'dataset', 'first_date')} to {_told(identity, 'dataset', 'last_date')}"), ("input checksum", _told(identity, "dataset", "input_checksums", run.RETURNS)),
                ("source", _told(manifest, "source", "source_sha256")), ("commit", _told(manifest, "source", "git_commit")),
            )
        ),
        "Method and traceability": f"Forecasts use data up to their origin only; candidates are paired with benchmarks date by date. Intervals come from {config['evaluation']['bootstrap_resamples']} moving-block resamples of {config['evaluation']['bootstrap_block_length']} days with seed {config['experiment']['random_seed']}. All numbers come from the saved tables of this folder.",
        "Limitations": "Results describe this history and these settings. Failed forecasts are counted, not replaced. Scores and calibration are different properties.",
    }
    return "\n\n".join([f"# Forecast evaluation: {identity['experiment_id']}", *[f"## {name}\n\n{body[name]}" for name in SECTIONS]]) + "\n"


def generate(spark: SparkSession, folder: Any) -> Report:
    """Writes the report into a verified experiment, or returns the one that is there."""
    folder = place_of(folder, spark)
    manifest = experiment.verify(folder)
    there = [n for n in FILES if (folder / n).exists()]
    if len(there) == len(FILES) and manifest["state"] == "complete":
        return Report(folder / experiment.REPORT, True)
    if there:
        raise fail("OUTPUT_COLLISION", f"These files exist already: {', '.join(there)}.")
    tables, identity = artifacts.read_tables(spark, folder), load_json(folder / experiment.EXPERIMENT, "ARTIFACT_RECONCILIATION_FAILED")
    part = (folder / "report").hidden_sibling().mkdirs()
    try:
        (part / experiment.REPORT).write_text(render(tables, identity, manifest))
        for name, data in figure_tables(tables, identity["configuration"]["historical"]["variance_window"]).items():
            (part / f"figures/{name}.svg").write_text(_drawn(name, data, series_of(identity)))
        if experiment.verify(folder) != manifest:
            raise fail("ARTIFACT_RECONCILIATION_FAILED", "The tables changed while the report was made.")
        (part / "figures").moved_to(folder / "figures")
        (part / experiment.REPORT).moved_to(folder / experiment.REPORT)
    finally:
        part.delete()
    experiment.finish(folder, list(FILES))
    experiment.verify(folder, complete=True)
    return Report(folder / experiment.REPORT, False)
