"""Experiments: an immutable folder of tables with a manifest, made in one move.

All files go to a hidden sibling folder first, on the file system of the output folder; it is
verified and renamed once, so a folder under its own name is always whole. States: numerical_complete, then complete once the report is there.
"""

from __future__ import annotations

import hashlib
import platform
import subprocess
from dataclasses import dataclass
from datetime import UTC, datetime
from importlib import metadata
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from riskloom import __version__
from riskloom.config import Config
from riskloom.errors import fail
from riskloom.operators import evaluation, reporting
from riskloom.plans import runner
from riskloom.sources import artifacts, run
from riskloom.sources.store import Place, load_json, place_of

# File names and states.
INPUT_MANIFEST, INPUT_QUALITY, DATASET, EXPERIMENT, RUN = "upstream_run_manifest.json", "upstream_data_quality_report.json", "dataset_manifest.json", "experiment_manifest.json", "run_manifest.json"
NUMERICAL = (INPUT_MANIFEST, INPUT_QUALITY, DATASET, EXPERIMENT, *artifacts.TABLES.values())
REPORT = "research_report.md"
STATES = ("numerical_complete", "complete")


@dataclass(frozen=True)
class Result:
    folder: Place
    manifest: dict[str, Any]
    reused: bool


def _git(*args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", str(_root()), *args], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def _root() -> Path:
    return Path(__file__).resolve().parents[1]


def source_identity() -> dict[str, Any]:
    """The code's version, tree digest and, where there is a repository, commit."""
    tree = hashlib.sha256()
    for path in sorted(_root().rglob("*.py")):
        tree.update(str(path.relative_to(_root())).encode() + b"\0" + hashlib.sha256(path.read_bytes()).digest())
    changed = _git("status", "--porcelain")
    return {"version": __version__, "source_sha256": tree.hexdigest(), "git_commit": _git("rev-parse", "HEAD"), "git_dirty": None if changed is None else bool(changed)}


def dependencies() -> dict[str, str]:
    return {"python": platform.python_version()} | {k: metadata.version(k) for k in ("pyspark", "numpy", "pandas", "pyarrow")}


def experiment_manifest(config: Config, dataset: dict[str, Any]) -> dict[str, Any]:
    """What makes an experiment the same: configuration, input and code."""
    code = {k: v for k, v in source_identity().items() if k in ("version", "source_sha256")}
    return {"experiment_id": config.experiment.experiment_id, "configuration": config.as_dict(), "dataset": dataset, "source": code}


def declared(folder: Place, names: tuple[str, ...] | list[str]) -> dict[str, Any]:
    """Hash and bytes of each file; of a table those of its list of parts, which has theirs."""
    out = {}
    for n in names:
        one = folder / n / artifacts.PARTS if n in artifacts.TABLES.values() else folder / n
        out[n] = {"sha256": one.sha256(), "bytes": one.size() if one.name != artifacts.PARTS else sum(p["bytes"] for p in artifacts.parts_of(folder / n))}
    return out


def run_manifest(folder: Place, state: str, names: list[str], before: dict[str, Any] | None = None) -> dict[str, Any]:
    now = datetime.now(UTC).isoformat()
    base = before or {"created_at": now, "source": source_identity(), "dependencies": dependencies()}
    return base | {"state": state, "updated_at": now, "artifacts": (before or {}).get("artifacts", {}) | declared(folder, names)}


def verify(folder: Any, complete: bool = False) -> dict[str, Any]:
    """The run manifest, after checking state, files, tables and all their checksums."""
    bad, folder = "ARTIFACT_RECONCILIATION_FAILED", place_of(folder)
    manifest = load_json(folder / RUN, bad)
    if manifest.get("state") not in STATES or (complete and manifest["state"] != "complete"):
        raise fail(bad, f"The experiment's state is {manifest.get('state')!r}.")
    told = manifest.get("artifacts") or {}
    lacking = [n for n in NUMERICAL if n not in told] + ([REPORT] if manifest["state"] == "complete" and REPORT not in told else [])
    if lacking:
        raise fail(bad, f"The manifest does not declare {', '.join(lacking)}.")
    tables = [n for n in told if n in artifacts.TABLES.values()]
    for name in told:
        if not (folder / name / artifacts.PARTS if name in tables else folder / name).is_file():
            raise fail(bad, f"{name} is missing.")
    try:
        changed = [n for n, entry in declared(folder, list(told)).items() if entry != told[n]]
    except Py4JError as e:
        raise fail(bad, f"A file can't be read: {e}") from e
    if changed:
        raise fail(bad, f"These have changed: {', '.join(changed)}.")
    artifacts.check_tables([folder / n for n in tables])
    return manifest


def execute(spark: SparkSession, config: Config, source: run.InputRun | None = None) -> Result:
    """Runs all models and evaluations, or returns the experiment that is there already."""
    source = source or run.load_run(spark, config)
    dataset = run.dataset_manifest(source, config)
    identity = experiment_manifest(config, dataset)
    final = place_of(config.experiment.output_dir, spark)
    if final.exists():
        if not (final / EXPERIMENT).is_file() or load_json(final / EXPERIMENT, "OUTPUT_COLLISION") != identity:
            raise fail("OUTPUT_COLLISION", f"{final} holds something else.")
        return Result(final, verify(final), True)
    part = final.hidden_sibling().mkdirs()
    try:
        panel = run.research_panel(source, config).cache()
        found = runner.available_models(panel, config, source.checksums[run.RETURNS])
        artifacts.write_tables({k: getattr(found, k) for k in artifacts.MODEL_TABLES}, part)
        # What is evaluated is what was saved; models do not run a second time.
        saved = runner.Artifacts(**{k: artifacts.read_table(spark, part, k) for k in artifacts.MODEL_TABLES})
        runner.check_artifacts(saved)
        tables = evaluation.evaluate(saved.forecasts, saved.realizations, config)
        artifacts.write_tables(tables, part)
        reporting.check_reconciled({k: artifacts.read_table(spark, part, k) for k in tables}, evaluation.test_years(config))
        panel.unpersist()
        (part / INPUT_MANIFEST).write_bytes((source.folder / run.MANIFEST).read_bytes())
        (part / INPUT_QUALITY).write_bytes((source.folder / run.QUALITY).read_bytes())
        (part / DATASET).write_json(dataset)
        (part / EXPERIMENT).write_json(identity)
        (part / RUN).write_json(run_manifest(part, STATES[0], list(NUMERICAL)))
        verify(part)
        part.moved_to(final)
    except BaseException:
        part.delete()
        raise
    return Result(final, load_json(final / RUN, "ARTIFACT_RECONCILIATION_FAILED"), False)


def finish(folder: Place, names: list[str]) -> dict[str, Any]:
    """Declares the report's files and sets the state to complete."""
    manifest = run_manifest(folder, "complete", names, load_json(folder / RUN, "ARTIFACT_RECONCILIATION_FAILED"))
    (folder / RUN).write_json(manifest, replace=True)
    return manifest
