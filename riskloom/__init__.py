"""A Spark-native engine for the evaluation of one-step-ahead variance and tail-loss forecasts.

The names below are loaded when first used, so importing the package starts nothing.
"""

from importlib import import_module

__version__ = "0.1.0"
_HOMES = {
    "load_config": "riskloom.config",
    "InputRun": "riskloom.sources.run",
    "load_run": "riskloom.sources.run",
    "CoverageRequirements": "riskloom.sources.run",
    "coverage_requirements": "riskloom.sources.run",
    "Dataset": "riskloom.sources.run",
    "build_dataset": "riskloom.sources.run",
    "write_dataset_manifest": "riskloom.sources.run",
    "Config": "riskloom.config",
    "research_panel": "riskloom.sources.run",
    "dataset_manifest": "riskloom.sources.run",
    "available_models": "riskloom.plans.runner",
    "execute": "riskloom.plans.experiment",
    "generate": "riskloom.plans.report",
    "evaluate": "riskloom.operators.evaluation",
}
__all__ = ["__version__", *_HOMES]


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"riskloom has no {name}")
    return getattr(import_module(_HOMES[name]), name)
