"""Command line: validate-input, run, report and reproduce.

A command is a list of steps. Each step takes what is known so far (a dictionary), adds to it
and names the lines to print; the labels are in LABELS.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

from pyspark.sql import SparkSession

from riskloom import __version__
from riskloom.config import load_config
from riskloom.errors import RiskError
from riskloom.plans import experiment, report
from riskloom.sources import run

# The labels of the printed lines.
LABELS = {
    "checked": "Input validation",
    "input": "Input run",
    "rows": "Return observations",
    "dates": "Return date range",
    "series": "Series",
    "hash": f"{run.RETURNS} SHA-256",
    "ran": "Numerical experiment",
    "folder": "Experiment directory",
    "state": "State",
    "reported": "Research report",
    "report": "Report path",
    "verified": "Reproduction verification",
}


class Work:
    """One call of the command line: what its options name, made when first asked for."""

    def __init__(self, options: argparse.Namespace) -> None:
        self.options = options

    @cached_property
    def spark(self) -> SparkSession:
        return SparkSession.builder.appName("riskloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()

    @cached_property
    def config(self):
        return load_config(self.options.config)

    @cached_property
    def source(self) -> run.InputRun:
        return run.load_run(self.spark, self.config)

    @cached_property
    def result(self) -> experiment.Result:
        return experiment.execute(self.spark, self.config, self.source)

    @property
    def folder(self):
        return self.options.experiment_dir if "experiment_dir" in self.options else self.result.folder


def check(work: Work) -> Iterator[tuple[str, str]]:
    facts = run.dataset_manifest(work.source, work.config)
    yield "checked", "ok"
    yield "input", work.source.folder
    yield "rows", facts["observation_count"]
    yield "dates", f"{facts['first_date']} through {facts['last_date']}"
    yield "series", ", ".join(facts["series_order"])
    yield "hash", work.source.checksums[run.RETURNS]


def evaluate(work: Work) -> Iterator[tuple[str, str]]:
    yield "ran", "reconciled" if work.result.reused else "completed"
    yield "folder", work.result.folder
    yield "state", work.result.manifest["state"]


def write_up(work: Work) -> Iterator[tuple[str, str]]:
    made = report.generate(work.spark, work.folder)
    yield "reported", "reconciled" if made.reused else "generated"
    yield "report", made.path


def verify(work: Work) -> Iterator[tuple[str, str]]:
    experiment.verify(work.folder, complete=True)
    yield "verified", "ok"


Step = Callable[[Work], Iterator[tuple[str, str]]]
#: Command: its required option and its steps.
COMMANDS: dict[str, tuple[str, tuple[Step, ...]]] = {
    "validate-input": ("--config", (check,)),
    "run": ("--config", (evaluate,)),
    "report": ("--experiment-dir", (write_up,)),
    "reproduce": ("--config", (check, evaluate, write_up, verify)),
}


def options_of(argv: Sequence[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="riskloom", description="Evaluate one-step-ahead variance and tail-loss forecasts.")
    top.add_argument("--version", action="version", version=__version__)
    by_name = top.add_subparsers(dest="command", required=True)
    for name, (needed, steps) in COMMANDS.items():
        by_name.add_parser(name, help=" then ".join(s.__name__.replace("_", " ") for s in steps)).add_argument(needed, required=True)
    return top.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> int:
    options = options_of(argv)
    work = Work(options)
    try:
        for step in COMMANDS[options.command][1]:
            for label, value in step(work):
                print(f"{LABELS[label]}: {value}")
    except RiskError as fault:
        print(fault, file=sys.stderr)
        return 2
    return 0
