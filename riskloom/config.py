"""Experiment configuration: a closed, strictly checked TOML document.

Every section is described by a table of fields (kind and bounds), so one walk checks missing
keys, unknown keys, types and ranges alike.
"""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, fields
from datetime import date
from pathlib import Path
from typing import Any

from riskloom.errors import fail

QUANTILE_METHODS = ("linear", "lower", "higher", "midpoint", "nearest")
PERIODS = ("development", "validation", "test")


@dataclass(frozen=True)
class Experiment:
    experiment_id: str
    input_run_dir: str
    output_dir: str
    random_seed: int


@dataclass(frozen=True)
class Upstream:
    """Identity that the input run must declare."""

    project: str
    package_version: str
    simple_returns_schema_id: str
    simple_returns_schema_version: str
    simple_returns_units: str
    instruments: tuple[str, ...]


@dataclass(frozen=True)
class Periods:
    development_start: date
    development_end: date
    validation_start: date
    validation_end: date
    test_start: date
    test_end: date

    def ranges(self) -> tuple[tuple[str, date, date], ...]:
        return tuple((p, getattr(self, f"{p}_start"), getattr(self, f"{p}_end")) for p in PERIODS)


@dataclass(frozen=True)
class Proxy:
    """Weights in the order of the instruments; none where there is no proxy series."""

    series_id: str | None = None
    weights: tuple[tuple[str, float], ...] = ()

    @property
    def enabled(self) -> bool:
        return self.series_id is not None


@dataclass(frozen=True)
class Historical:
    variance_window: int
    var_window: int
    quantile_method: str = "linear"


@dataclass(frozen=True)
class Ewma:
    lambda_: float
    initialization_window: int


@dataclass(frozen=True)
class Garch:
    estimation_window: int
    refit_every_origins: int
    input_scale: float = 100.0
    retry_count: int = 1
    stationarity_tolerance: float = 1e-8


@dataclass(frozen=True)
class Evaluation:
    bootstrap_block_length: int
    bootstrap_resamples: int
    bootstrap_confidence: float


@dataclass(frozen=True)
class Config:
    experiment: Experiment
    upstream: Upstream
    periods: Periods
    portfolio_proxy: Proxy
    historical: Historical
    ewma: Ewma
    garch: Garch
    evaluation: Evaluation

    def largest_window(self) -> int:
        h = self.historical
        return max(h.variance_window, h.var_window, self.ewma.initialization_window, self.garch.estimation_window)

    def series(self) -> tuple[str, ...]:
        extra = (self.portfolio_proxy.series_id,) if self.portfolio_proxy.enabled else ()
        return (*self.upstream.instruments, *extra)

    def as_dict(self) -> dict[str, Any]:
        """The effective configuration in plain JSON types."""
        out: dict[str, Any] = {}
        for section in fields(self):
            value = getattr(self, section.name)
            if section.name == "portfolio_proxy":
                out[section.name] = {"enabled": value.enabled} | ({"series_id": value.series_id, "weights": dict(value.weights)} if value.enabled else {})
                continue
            plain = {f.name.rstrip("_"): getattr(value, f.name) for f in fields(value)}
            out[section.name] = {k: v.isoformat() if isinstance(v, date) else list(v) if isinstance(v, tuple) else v for k, v in plain.items()}
        return out


# Kind, least, most; an open bound is given by a tuple (value, "open").
_FIELDS: dict[str, dict[str, tuple]] = {
    "experiment": {"experiment_id": ("text",), "input_run_dir": ("text",), "output_dir": ("text",), "random_seed": ("int", 0)},
    "upstream": {k: ("text",) for k in ("project", "package_version", "simple_returns_schema_id", "simple_returns_schema_version", "simple_returns_units")} | {"instruments": ("names",)},
    "periods": {f"{p}_{e}": ("date",) for p in PERIODS for e in ("start", "end")},
    "historical": {"variance_window": ("int", 2), "var_window": ("int", 2), "quantile_method": ("text",)},
    "ewma": {"lambda": ("number", (0.0, "open"), (1.0, "open")), "initialization_window": ("int", 2)},
    "garch": {
        "estimation_window": ("int", 2),
        "refit_every_origins": ("int", 1),
        "input_scale": ("number", (0.0, "open")),
        "retry_count": ("int", 0, 1),
        "stationarity_tolerance": ("number", 0.0, (1.0, "open")),
    },
    "evaluation": {"bootstrap_block_length": ("int", 1), "bootstrap_resamples": ("int", 1), "bootstrap_confidence": ("number", (0.0, "open"), (1.0, "open"))},
}


def _invalid(message: str):
    return fail("CONFIG_INVALID", message)


def _keys(table: Any, name: str, expected: set[str]) -> dict:
    if not isinstance(table, dict):
        raise _invalid(f"{name} must be a table.")
    for what, found in (("unknown", table.keys() - expected), ("missing", expected - table.keys())):
        if found:
            raise _invalid(f"{name} has {what} keys: {', '.join(sorted(found))}.")
    return table


def _bounded(value: float, where: str, low, high) -> None:
    for bound, sign in ((low, 1), (high, -1)):
        if bound is None:
            continue
        edge, is_open = (bound[0], True) if isinstance(bound, tuple) else (bound, False)
        if sign * (value - edge) < 0 or (is_open and value == edge):
            raise _invalid(f"{where} is out of range.")


def _value(raw: Any, where: str, kind: str, low=None, high=None) -> Any:
    if kind == "text":
        if not isinstance(raw, str) or not raw.strip():
            raise _invalid(f"{where} must be a non-empty string.")
        return raw.strip()
    if kind == "names":
        if not isinstance(raw, list) or not raw or any(not isinstance(x, str) or not x.strip() for x in raw):
            raise _invalid(f"{where} must be a list of non-empty strings.")
        names = tuple(x.strip().upper() for x in raw)
        if len(set(names)) < len(names):
            raise _invalid(f"{where} repeats a name.")
        return names
    if kind == "date":
        try:
            return raw if isinstance(raw, date) and type(raw) is date else date.fromisoformat(raw)
        except (TypeError, ValueError) as e:
            raise _invalid(f"{where} must be an ISO date.") from e
    if isinstance(raw, bool) or not isinstance(raw, int if kind == "int" else (int, float)) or not math.isfinite(raw):
        raise _invalid(f"{where} must be {'an integer' if kind == 'int' else 'a finite number'}.")
    _bounded(raw, where, low, high)
    return raw if kind == "int" else float(raw)


def _proxy(raw: Any, instruments: tuple[str, ...]) -> Proxy:
    if not isinstance(raw, dict) or not isinstance(raw.get("enabled"), bool):
        raise _invalid("portfolio_proxy.enabled must be true or false.")
    if not raw["enabled"]:
        _keys(raw, "portfolio_proxy", {"enabled"})
        return Proxy()
    _keys(raw, "portfolio_proxy", {"enabled", "series_id", "weights"})
    name = _value(raw["series_id"], "portfolio_proxy.series_id", "text")
    if name in instruments:
        raise _invalid("portfolio_proxy.series_id is the name of an instrument.")
    weights = _keys(raw["weights"], "portfolio_proxy.weights", set(instruments))
    checked = {k: _value(w, f"portfolio_proxy.weights.{k}", "number", 0.0) for k, w in weights.items()}
    if abs(sum(checked.values()) - 1) > 1e-12:
        raise _invalid("portfolio_proxy.weights must sum to one.")
    return Proxy(name, tuple((k, checked[k]) for k in instruments))


def build_config(raw: dict[str, Any]) -> Config:
    _keys(raw, "the configuration", {*_FIELDS, "portfolio_proxy"})
    kinds = {"experiment": Experiment, "upstream": Upstream, "periods": Periods, "historical": Historical, "ewma": Ewma, "garch": Garch, "evaluation": Evaluation}
    made: dict[str, Any] = {}
    for name, described in _FIELDS.items():
        table = _keys(raw[name], name, set(described))
        values = {k: _value(table[k], f"{name}.{k}", *rule) for k, rule in described.items()}
        made[name] = kinds[name](**{"lambda_" if k == "lambda" else k: v for k, v in values.items()})
    if Path(made["experiment"].input_run_dir) == Path(made["experiment"].output_dir):
        raise _invalid("experiment.input_run_dir and experiment.output_dir must differ.")
    bounds = [b for _, start, end in made["periods"].ranges() for b in (start, end)]
    if any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise _invalid("The bounds of the periods must increase strictly.")
    if made["historical"].quantile_method not in QUANTILE_METHODS:
        raise _invalid(f"historical.quantile_method must be one of {', '.join(QUANTILE_METHODS)}.")
    return Config(portfolio_proxy=_proxy(raw["portfolio_proxy"], made["upstream"].instruments), **made)


def load_config(path: str | Path) -> Config:
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise _invalid(f"The configuration can't be read: {e}") from e
    return build_config(raw)
