"""Saved tables: CSV for tables that people read, Parquet for those that programs read.

A table is a folder of parts in a fixed order of rows, written by executors: the sort deals
the rows out by range, and each range becomes one part. Executors also hash the parts. The
driver writes the list of parts and hashes, then commits the folder with one rename. Spark's
committer leaves one part of a task, however often it ran.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.errors import fail
from riskloom.operators import evaluation, reporting, windows
from riskloom.sources.store import Place, load_json, place_of

# Names of the saved tables.
MODEL_TABLES = {"experiment_windows": "experiment_windows.csv", "realizations": "realizations.parquet", "forecasts": "forecasts.parquet", "fit_diagnostics": "fit_diagnostics.parquet"}
EVALUATION_TABLES = {k: f"{k}.csv" for k in ("forecast_availability", "variance_scores", "quantile_scores", "coverage_tests", "bootstrap_comparisons", "period_breakdowns")}
TABLES = MODEL_TABLES | EVALUATION_TABLES
#: The list of a table's parts; readers pass over names that begin with an underscore.
PARTS = "_parts.json"
#: Rows of a part at most, so that one can be hashed in memory.
PART_ROWS = 2_000_000
#: The order of the model tables; the other tables have a canonical one.
ORDER = {"experiment_windows": ["series_id", "model_id", "forecast_origin"], "forecasts": ["series_id", "model_id", "forecast_origin"], "realizations": ["series_id", "forecast_origin"], "fit_diagnostics": ["series_id", "model_id", "fit_origin"]}
_BAD = "ARTIFACT_RECONCILIATION_FAILED"
_WHOLE = {"observation_count", "paired_count", "bootstrap_resamples", "block_length", "random_seed", "train_observation_count"}
_TEXT = {"experiment_id", "period", "series_id", "model_id", "metric", "status", "benchmark_model_id", "effect_direction", "period_start", "period_end"}
_COLUMNS = {"experiment_windows": windows.WINDOWS} | reporting.SCHEMAS


def hashed(spark: SparkSession, folders: list[Place]) -> dict[str, dict[str, Any]]:
    """{URI: {sha256, bytes}} of all parts in the folders, hashed where they are read."""
    if not folders:
        return {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f.uri for f in folders])
    return {Place(r["path"], spark).uri: {"sha256": r["sha256"], "bytes": r["length"]} for r in files.select("path", "length", F.sha2("content", 256).alias("sha256")).collect()}


def listed(folder: Place) -> list[Place]:
    return [p for p in folder.children() if p.name.startswith("part-")]


def write_table(df: DataFrame, path: Any, order: list[str] | None = None) -> Place:
    """The table in a fixed order of rows under `path`, all of it or nothing; a table that is
    there is never replaced."""
    spark = df.sparkSession
    path = place_of(path, spark)
    if path.exists():
        raise fail("OUTPUT_COLLISION", f"{path.name} exists already.")
    staged = path.hidden_sibling()
    rows = (df.orderBy(*order) if order else evaluation.ordered(df)).write.option("maxRecordsPerFile", PART_ROWS)
    try:
        if path.name.endswith(".csv"):
            rows.option("header", True).option("dateFormat", "yyyy-MM-dd").option("nullValue", "").option("emptyValue", "").csv(staged.uri)
        else:
            rows.parquet(staged.uri)
        found = hashed(spark, [staged])
        parts = [{"name": p.name, **found[p.uri]} for p in listed(staged)]
        (staged / PARTS).write_json({"order": order or "canonical", "parts": parts})
        staged.moved_to(path)
    except BaseException:
        staged.delete()
        raise
    return path


def parts_of(path: Place) -> list[dict[str, Any]]:
    """The declared parts of a saved table."""
    if not (path / PARTS).is_file():
        raise fail(_BAD, f"{path.name} is missing or not a saved table.")
    return load_json(path / PARTS, _BAD)["parts"]


def check_tables(paths: list[Place]) -> None:
    """Every declared part is there with its bytes, and no other part is."""
    for path in paths:
        if [p["name"] for p in parts_of(path)] != [p.name for p in listed(path)]:
            raise fail(_BAD, f"{path.name} does not have its parts.")
    if not paths:
        return
    try:
        found = hashed(paths[0].spark, paths)
    except (PySparkException, Py4JError) as e:
        raise fail(_BAD, f"A part of the saved tables can't be read: {e}") from e
    for path in paths:
        for part in parts_of(path):
            if found.get((path / part["name"]).uri) != {"sha256": part["sha256"], "bytes": part["bytes"]}:
                raise fail(_BAD, f"{path.name}: {part['name']} has changed.")


def write_tables(tables: Mapping[str, DataFrame], folder: Any) -> None:
    """All tables or none: any collision is found before the first write."""
    folder = place_of(folder)
    there = [TABLES[k] for k in tables if (folder / TABLES[k]).exists()]
    if there:
        raise fail("OUTPUT_COLLISION", f"These files exist already: {', '.join(there)}.")
    folder.mkdirs()
    for name, table in tables.items():
        write_table(table, folder / TABLES[name], ORDER.get(name))


def _kind(column: str) -> str:
    if column in _WHOLE:
        return "bigint"
    if column in _TEXT:
        return "string"
    if column == "scheduled_refit":
        return "boolean"
    return "date" if column in ("forecast_origin", "target_date", "train_start", "train_end") else "double"


def read_table(spark: SparkSession, folder: Any, name: str) -> DataFrame:
    path = place_of(folder, spark) / TABLES[name]
    if not path.is_dir():
        raise fail(_BAD, f"{path.name} is missing.")
    if path.name.endswith(".parquet"):
        return spark.read.parquet(path.uri)
    columns = _COLUMNS[name]
    if any(tuple(p.first_line().split(",")) != tuple(columns) for p in listed(path)[:1]):
        raise fail(_BAD, f"{path.name} does not have its columns.")
    schema = ", ".join(f"{c} {_kind(c)}" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path.uri)


def read_tables(spark: SparkSession, folder: Any) -> dict[str, DataFrame]:
    return {k: read_table(spark, folder, k) for k in TABLES}


def digest_of(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or files."""
    cells = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns])
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(cells.cast("decimal(38,0)")).alias("s")).first()
    return f"{total.n}:{total.s or 0}"
