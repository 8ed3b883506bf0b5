import dataclasses
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from helpers import config_raw, edit, write_run

from riskloom import cli
from riskloom.config import build_config
from riskloom.errors import BY_CODE, RiskError
from riskloom.operators import panel
from riskloom.plans import experiment, report
from riskloom.sources import artifacts, run


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("run")
    write_run(top)
    config = build_config(config_raw(top))
    return config, experiment.execute(spark, config)


def test_experiment_is_whole_and_reused(spark, done):
    config, result = done
    assert result.manifest["state"] == "numerical_complete" and not result.reused
    assert set(result.manifest["artifacts"]) == set(experiment.NUMERICAL)
    assert experiment.execute(spark, config).reused


def test_saved_tables_have_the_expected_rows(spark, done):
    _, result = done
    tables = artifacts.read_tables(spark, result.folder)
    n, series = 260, 3
    by_model = {r.model_id: r["count"] for r in tables["forecasts"].groupBy("model_id").count().collect()}
    assert by_model["historical_variance"] == series * (n - 20) == by_model["ewma"]
    assert by_model["historical_simulation"] == series * (n - 30)
    assert by_model["garch_1_1_gaussian"] == series * (n - 60) == by_model["garch_1_1_student_t"]
    assert tables["realizations"].count() == series * (n - 20)
    fits = {r.model_id: r["count"] for r in tables["fit_diagnostics"].groupBy("model_id").count().collect()}
    assert fits == {"ewma": series, "garch_1_1_gaussian": series * 10, "garch_1_1_student_t": series * 10}
    assert tables["bootstrap_comparisons"].count() == 5 * 2 * 3 * (series + 1)


def test_report_then_complete_then_tampering(spark, done):
    _, result = done
    made = report.generate(spark, result.folder)
    text = made.path.read_text()
    assert [line[3:] for line in text.splitlines() if line.startswith("## ")] == list(report.SECTIONS)
    assert experiment.verify(result.folder, complete=True)["state"] == "complete"
    assert report.generate(spark, result.folder).reused
    parts = [p for p in Path(result.folder / "variance_scores.csv").iterdir() if p.name.startswith("part-")]
    before = parts[0].read_text()
    parts[0].write_text(before + "x")
    with pytest.raises(BY_CODE["ARTIFACT_RECONCILIATION_FAILED"]):
        experiment.verify(result.folder)
    parts[0].write_text(before)
    experiment.verify(result.folder)
    (parts[0].parent / "part-99999.csv").write_text(before)
    with pytest.raises(BY_CODE["ARTIFACT_RECONCILIATION_FAILED"], match="does not have its parts"):
        experiment.verify(result.folder)
    (parts[0].parent / "part-99999.csv").unlink()
    parts[0].rename(top := parts[0].with_name("gone"))
    with pytest.raises(BY_CODE["ARTIFACT_RECONCILIATION_FAILED"]):
        experiment.verify(result.folder)
    top.rename(parts[0])
    listing = Path(result.folder / "forecasts.parquet" / artifacts.PARTS)
    kept = listing.read_text()
    listing.with_name(f".{listing.name}.crc").unlink(missing_ok=True)
    listing.write_text(kept.replace("part-", "part_"))
    with pytest.raises(BY_CODE["ARTIFACT_RECONCILIATION_FAILED"], match="have changed"):
        experiment.verify(result.folder)
    listing.write_text(kept)
    experiment.verify(result.folder)


def test_a_table_is_parts_by_range_and_its_manifest(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.lit("x").alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("t.parquet", "t.csv"):
            path = artifacts.write_table(rows, tmp_path / name, ["k"])
            parts = artifacts.parts_of(path)
            assert len(parts) >= 3 and [p.name for p in artifacts.listed(path)] == [p["name"] for p in parts]
            read = [spark.read.parquet((path / p["name"]).uri) if name.endswith("parquet") else spark.read.csv((path / p["name"]).uri, header=True) for p in parts]
            assert [int(r.k) for df in read for r in df.collect()] == list(range(3000))
            artifacts.check_tables([path])
            with pytest.raises(BY_CODE["OUTPUT_COLLISION"]):
                artifacts.write_table(rows, tmp_path / name, ["k"])
        assert not [p for p in tmp_path.iterdir() if p.name.startswith(".t.")]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="broken"):
        artifacts.write_table(spark.range(9).select(F.raise_error(F.lit("broken")).cast("int").alias("k")), tmp_path / "t.parquet", ["k"])
    assert not list(tmp_path.iterdir())


TWICE = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from riskloom.session import importable
from riskloom.sources import artifacts
spark = importable(SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate())

def fails_once(batches):
    for rows in batches:
        yield rows
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("an executor is lost")

rows = spark.range(0, 1000, 1, 3).mapInPandas(fails_once, "id bigint")
path = artifacts.write_table(rows.sort("id").mapInPandas(fails_once, "id bigint"), sys.argv[1], ["id"])
artifacts.check_tables([path])
found = [r.id for r in spark.read.parquet(path.uri).collect()]
assert sorted(found) == list(range(1000)), len(found)
assert len(artifacts.parts_of(path)) >= 3
print("whole")
"""


def test_tasks_that_run_twice_leave_one_part_each(tmp_path):
    done = subprocess.run([sys.executable, "-c", TWICE, str(tmp_path / "t.parquet")], capture_output=True, text=True, timeout=300, cwd=Path(__file__).resolve().parents[1])
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]


def test_rows_of_files_are_numbered_by_split(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text("\n".join(["v", *map(str, range(5000))]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = spark.read.csv(str(path), header=True)
        assert rows.rdd.getNumPartitions() > 3
        assert all(int(r.v) == r.pos for r in panel.numbered(rows, "pos").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_collision(spark, done):
    config, _ = done
    raw = config_raw(config_top := __import__("pathlib").Path(config.experiment.output_dir).parent)
    raw["evaluation"]["bootstrap_resamples"] = 51
    assert config_top.exists()
    with pytest.raises(BY_CODE["OUTPUT_COLLISION"]):
        experiment.execute(spark, build_config(raw))


@pytest.mark.parametrize(
    ("file", "change", "code"),
    [
        ("run_manifest.json", lambda r: r.update(project="other"), "UPSTREAM_MANIFEST_INVALID"),
        ("run_manifest.json", lambda r: r.update(project_version="2"), "UPSTREAM_VERSION_INCOMPATIBLE"),
        ("run_manifest.json", lambda r: r["data_source"].update(instruments=["BB", "AA"]), "UPSTREAM_MANIFEST_INVALID"),
        ("run_manifest.json", lambda r: r["artifact_schemas"]["simple_returns.csv"].update(units="x"), "UPSTREAM_SCHEMA_INCOMPATIBLE"),
        ("run_manifest.json", lambda r: r["estimation_conventions"]["missing_data"].update(forward_fill=True), "UPSTREAM_QUALITY_GATE_FAILED"),
        ("data_quality_report.json", lambda r: r.update(common_date_count_after_alignment=10), "UPSTREAM_QUALITY_GATE_FAILED"),
        ("data_quality_report.json", lambda r: r.update(first_common_date="2019-12-01"), "UPSTREAM_QUALITY_GATE_FAILED"),
        ("data_quality_report.json", lambda r: r.update(last_common_date="2019-02-01"), "UPSTREAM_QUALITY_GATE_FAILED"),
        ("data_quality_report.json", lambda r: r.update(returned_instruments=["AA"]), "UPSTREAM_QUALITY_GATE_FAILED"),
    ],
)
def test_gates_of_the_documents(spark, tmp_path, file, change, code):
    write_run(tmp_path)
    edit(tmp_path / "in" / file, change)
    with pytest.raises(BY_CODE[code]):
        run.load_run(spark, build_config(config_raw(tmp_path)))


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda x: [*x[:3], x[2], *x[3:]], "INPUT_DATE_DUPLICATE"),
        (lambda x: [x[0], x[2], x[1], *x[3:]], "INPUT_DATE_UNSORTED"),
        (lambda x: [*x[:5], x[5].rsplit(",", 1)[0] + ",abc", *x[6:]], "INPUT_VALUE_INVALID"),
        (lambda x: [*x[:5], x[5].rsplit(",", 1)[0] + ",Infinity", *x[6:]], "INPUT_VALUE_INVALID"),
        (lambda x: ["date,BB,AA", *x[1:]], "UPSTREAM_SCHEMA_INCOMPATIBLE"),
        (lambda x: x[:-1], "UPSTREAM_QUALITY_GATE_FAILED"),
    ],
)
def test_gates_of_the_table(spark, tmp_path, change, code):
    write_run(tmp_path)
    path = tmp_path / "in" / "simple_returns.csv"
    path.write_text("\n".join(change(path.read_text().splitlines())) + "\n")
    with pytest.raises(BY_CODE[code]):
        run.load_run(spark, build_config(config_raw(tmp_path)))


def test_missing_file_and_package(spark, tmp_path):
    write_run(tmp_path)
    config = build_config(config_raw(tmp_path))
    with pytest.raises(BY_CODE["UPSTREAM_PACKAGE_MISSING"]):
        run.load_run(spark, config, installed=lambda: None)
    with pytest.raises(BY_CODE["UPSTREAM_VERSION_INCOMPATIBLE"]):
        run.load_run(spark, config, installed=lambda: "0.9")
    (tmp_path / "in" / "run_manifest.json").unlink()
    with pytest.raises(BY_CODE["UPSTREAM_MANIFEST_INVALID"]):
        run.load_run(spark, config)


def test_command_line(spark, tmp_path, capsys):
    write_run(tmp_path)
    raw = config_raw(tmp_path)
    lines = []
    for section, table in raw.items():
        lines.append(f"[{section}]")
        for k, v in table.items():
            text = json.dumps(v) if not isinstance(v, dict) else "{" + ", ".join(f"{a} = {b}" for a, b in v.items()) + "}"
            lines.append(f"{k} = {text}")
    path = tmp_path / "c.toml"
    path.write_text("\n".join(lines))
    assert cli.main(["validate-input", "--config", str(path)]) == 0
    assert "Input validation: ok" in capsys.readouterr().out
    path.write_text(path.read_text().replace("lambda = 0.9", "lambda = 1.9"))
    assert cli.main(["run", "--config", str(path)]) == 2
    assert capsys.readouterr().err.startswith("CONFIG_INVALID: ")
    assert issubclass(BY_CODE["CONFIG_INVALID"], RiskError)


def test_requirements_and_the_dataset_manifest(spark, tmp_path):
    write_run(tmp_path)
    config = build_config(config_raw(tmp_path))
    needs = run.coverage_requirements(config)
    assert (needs.least_common_dates, needs.largest_window) == (62, 60) and needs.first_date_not_after == config.periods.development_end
    loaded = run.load_run(spark, config)
    data = run.build_dataset(loaded, config)
    path = run.write_dataset_manifest(data, tmp_path / "dataset.json")
    assert json.loads((tmp_path / "dataset.json").read_text()) == data.manifest and path.name == "dataset.json"
    assert data.manifest["observation_count"] * 3 == data.panel.count()
    with pytest.raises(BY_CODE["OUTPUT_COLLISION"]):
        run.write_dataset_manifest(data, tmp_path / "dataset.json")
    with pytest.raises(BY_CODE["UPSTREAM_QUALITY_GATE_FAILED"]):
        run.load_run(spark, config, coverage=dataclasses.replace(needs, least_common_dates=10_000))
