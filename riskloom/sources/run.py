"""The validated input run: a folder with simple_returns.csv and two JSON documents.

The checks run in a fixed order, so the first fault decides the error: files, version, JSON,
manifest, quality report, table, checksums. The table's checks are small Spark aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import Config
from riskloom.errors import fail
from riskloom.operators import panel
from riskloom.operators.windows import period_of
from riskloom.sources.store import Place, load_json, place_of

# File names, and the adjustment counts that the quality report must hold.
RETURNS, MANIFEST, QUALITY = "simple_returns.csv", "run_manifest.json", "data_quality_report.json"
FILES = (QUALITY, MANIFEST, RETURNS)
ADJUSTMENTS = ("duplicate_date_instrument_rows_removed", "invalid_price_values_removed", "common_history_rows_removed")


@dataclass(frozen=True)
class InputRun:
    folder: Place
    returns: DataFrame
    manifest: dict[str, Any]
    quality: dict[str, Any]
    checksums: dict[str, str]
    version: str


@dataclass(frozen=True)
class CoverageRequirements:
    """What the common history of an input must cover."""

    least_common_dates: int
    first_date_not_after: date
    last_date_not_before: date
    largest_window: int
    periods: tuple[tuple[str, date, date], ...]


def coverage_requirements(config: Config) -> CoverageRequirements:
    """The requirements that follow from the periods and the largest window of a configuration."""
    p, window = config.periods, config.largest_window()
    return CoverageRequirements(window + 2, p.development_end, p.test_start, window, tuple(p.ranges()))


@dataclass(frozen=True)
class Dataset:
    """The panel that models run on, and the evidence of where it came from."""

    panel: DataFrame
    manifest: dict[str, Any]


def _part(raw: dict, key: str, code: str) -> dict:
    if not isinstance(raw.get(key), dict):
        raise fail(code, f"{key} must be an object.")
    return raw[key]


def _names(raw: Any, what: str, code: str) -> tuple[str, ...]:
    if not isinstance(raw, list) or not raw or any(not isinstance(x, str) or not x for x in raw) or len(set(raw)) < len(raw):
        raise fail(code, f"{what} must be a list of distinct names.")
    return tuple(raw)


def _day(raw: Any, what: str) -> date:
    try:
        return date.fromisoformat(raw)
    except (TypeError, ValueError) as e:
        raise fail("UPSTREAM_QUALITY_GATE_FAILED", f"{what} must be an ISO date.") from e


def _count(raw: Any, what: str) -> int:
    if isinstance(raw, bool) or not isinstance(raw, int) or raw < 0:
        raise fail("UPSTREAM_QUALITY_GATE_FAILED", f"{what} must be a count.")
    return raw


def check_manifest(manifest: dict[str, Any], config: Config) -> None:
    want, bad = config.upstream, "UPSTREAM_MANIFEST_INVALID"
    if manifest.get("project") != want.project:
        raise fail(bad, "The run is of another project.")
    if manifest.get("project_version") != want.package_version:
        raise fail("UPSTREAM_VERSION_INCOMPATIBLE", "The run is of another version.")
    if _names(_part(manifest, "data_source", bad).get("instruments"), "instruments", bad) != want.instruments:
        raise fail(bad, "The run has other instruments, or another order of them.")
    declared = _part(_part(manifest, "artifact_schemas", "UPSTREAM_SCHEMA_INCOMPATIBLE"), RETURNS, "UPSTREAM_SCHEMA_INCOMPATIBLE")
    expected = {"schema_id": want.simple_returns_schema_id, "schema_version": want.simple_returns_schema_version, "units": want.simple_returns_units}
    if any(declared.get(k) != v for k, v in expected.items()):
        raise fail("UPSTREAM_SCHEMA_INCOMPATIBLE", f"{RETURNS} has another schema, version or unit.")
    if _part(_part(manifest, "estimation_conventions", bad), "missing_data", bad).get("forward_fill") is not False:
        raise fail("UPSTREAM_QUALITY_GATE_FAILED", "The run must declare forward_fill as false.")


def check_quality(quality: dict[str, Any], config: Config, coverage: CoverageRequirements) -> None:
    bad, want = "UPSTREAM_QUALITY_GATE_FAILED", config.upstream.instruments
    if _names(quality.get("requested_instruments"), "requested_instruments", bad) != want:
        raise fail(bad, "The quality report is for other instruments.")
    absent = set(want) - set(_names(quality.get("returned_instruments"), "returned_instruments", bad))
    if absent:
        raise fail(bad, f"The input lacks {', '.join(sorted(absent))}.")
    if _count(quality.get("common_date_count_after_alignment"), "common_date_count_after_alignment") < coverage.least_common_dates:
        raise fail(bad, "The common history is shorter than the largest window needs.")
    if _day(quality.get("first_common_date"), "first_common_date") > coverage.first_date_not_after:
        raise fail(bad, "The common history begins after the development period.")
    if _day(quality.get("last_common_date"), "last_common_date") < coverage.last_date_not_before:
        raise fail(bad, "The common history ends before the test period.")


def adjustments(quality: dict[str, Any]) -> dict[str, int]:
    return {k: _count(quality.get(k), k) for k in ADJUSTMENTS}


def read_returns(spark: SparkSession, path: Place, names: tuple[str, ...]) -> DataFrame:
    """The wide table with its file order as pos; values stay text until they are checked."""
    header = path.first_line().strip().split(",")
    if header != ["date", *names]:
        raise fail("UPSTREAM_SCHEMA_INCOMPATIBLE", f"{RETURNS} must have the columns date, {', '.join(names)}.")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path.uri)
    return panel.numbered(rows, "pos")


def check_returns(rows: DataFrame, quality: dict[str, Any], config: Config, coverage: CoverageRequirements) -> DataFrame:
    names = config.upstream.instruments
    typed = rows.select("pos", F.expr("try_cast(date AS date)").alias("date"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in names])
    broken = F.col("date").isNull()
    for c in names:
        broken |= F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    inside = (F.col("pos") >= coverage.largest_window) & F.col("period").isNotNull()
    placed = typed.withColumn("period", period_of(F.col("date"), config.periods))
    if placed.where(broken).limit(1).count():
        raise fail("INPUT_VALUE_INVALID", f"{RETURNS} holds a value that is not a finite number or a date.")
    panel.check_index(placed.select("pos", "date"))
    told = placed.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.collect_set(F.when(inside, F.col("period"))).alias("periods")).first()
    bad = "UPSTREAM_QUALITY_GATE_FAILED"
    if told.n != quality["common_date_count_after_alignment"] - 1:
        raise fail(bad, "The number of returns does not fit the number of common dates.")
    if told.first <= _day(quality["first_common_date"], "first_common_date") or told.last != _day(quality["last_common_date"], "last_common_date"):
        raise fail(bad, "The dates of the returns do not fit the quality report.")
    lacking = {name for name, _, _ in coverage.periods} - set(told.periods)
    if lacking:
        raise fail("INSUFFICIENT_HISTORY", f"No target with enough history lies in: {', '.join(sorted(lacking))}.")
    return placed.select("date", *names)


def load_run(spark: SparkSession, config: Config, installed: Callable[[], str | None] | None = None, coverage: CoverageRequirements | None = None) -> InputRun:
    """Validates and loads the configured input run. `installed` gives the version of the
    package that made it, where one must be present (None: missing). coverage: requirements
    other than the configuration's own."""
    coverage = coverage or coverage_requirements(config)
    folder = place_of(config.experiment.input_run_dir, spark)
    absent = [f for f in FILES if not (folder / f).is_file()]
    if absent:
        raise fail("UPSTREAM_MANIFEST_INVALID", f"The input run lacks {', '.join(absent)}.")
    version = installed() if installed else config.upstream.package_version
    if version is None:
        raise fail("UPSTREAM_PACKAGE_MISSING", "The package that made the run is not installed.")
    if version != config.upstream.package_version:
        raise fail("UPSTREAM_VERSION_INCOMPATIBLE", "Another version of the package that made the run is installed.")
    manifest, quality = (load_json(folder / f, "UPSTREAM_MANIFEST_INVALID") for f in (MANIFEST, QUALITY))
    check_manifest(manifest, config)
    check_quality(quality, config, coverage)
    rows = read_returns(spark, folder / RETURNS, config.upstream.instruments)
    returns = check_returns(rows, quality, config, coverage)
    return InputRun(folder, returns, manifest, quality, {f: (folder / f).sha256() for f in FILES}, version)


def research_panel(run: InputRun, config: Config) -> DataFrame:
    """The long panel of the instruments and, where it is enabled, the proxy."""
    long = panel.to_long(run.returns, list(config.upstream.instruments))
    if config.portfolio_proxy.enabled:
        return panel.with_long_proxy(long, dict(config.portfolio_proxy.weights), config.portfolio_proxy.series_id)
    return long


def dataset_manifest(run: InputRun, config: Config) -> dict[str, Any]:
    told = run.returns.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).first()
    return {
        "input_run_dir": str(run.folder),
        "input_checksums": run.checksums,
        "input_version": run.version,
        "adjustment_counts": adjustments(run.quality),
        "observation_count": told.n,
        "first_date": told.first.isoformat(),
        "last_date": told.last.isoformat(),
        "series_order": list(config.series()),
        "portfolio_proxy": config.as_dict()["portfolio_proxy"],
    }


def build_dataset(run: InputRun, config: Config) -> Dataset:
    return Dataset(research_panel(run, config), dataset_manifest(run, config))


def write_dataset_manifest(dataset: Dataset, path: Any) -> Place:
    """The evidence as JSON at a path of any file system; a file that is there is not replaced."""
    place = place_of(path, dataset.panel.sparkSession)
    if place.exists():
        raise fail("OUTPUT_COLLISION", f"{place.name} exists already.")
    place.write_json(dataset.manifest)
    return place
