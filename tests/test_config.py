import copy
from pathlib import Path

import pytest
from helpers import config_raw

from riskloom.config import build_config, load_config
from riskloom.errors import BY_CODE, CODES, fail

INVALID = BY_CODE["CONFIG_INVALID"]


@pytest.fixture
def raw(tmp_path):
    return config_raw(tmp_path)


def test_valid(raw):
    c = build_config(raw)
    assert c.series() == ("AA", "BB", "MIX") and c.largest_window() == 60
    assert c.as_dict()["ewma"] == {"lambda": 0.9, "initialization_window": 20}
    assert c.as_dict()["periods"]["test_start"] == "2019-09-01"


@pytest.mark.parametrize(
    ("path", "value"),
    [
        ("experiment.random_seed", True),
        ("experiment.random_seed", -1),
        ("experiment.experiment_id", " "),
        ("upstream.instruments", []),
        ("upstream.instruments", ["AA", "aa"]),
        ("periods.test_start", "2019-08-31"),
        ("periods.test_start", "soon"),
        ("historical.variance_window", 1),
        ("historical.variance_window", 20.0),
        ("historical.quantile_method", "median"),
        ("ewma.lambda", 1.0),
        ("ewma.lambda", 0),
        ("garch.retry_count", 2),
        ("garch.input_scale", 0.0),
        ("garch.stationarity_tolerance", 1.0),
        ("garch.refit_every_origins", 0),
        ("evaluation.bootstrap_confidence", 1.0),
        ("evaluation.bootstrap_resamples", 0),
        ("portfolio_proxy.weights", {"AA": 0.5, "BB": 0.4}),
        ("portfolio_proxy.weights", {"AA": 1.0}),
        ("portfolio_proxy.weights", {"AA": 1.5, "BB": -0.5}),
        ("portfolio_proxy.series_id", "AA"),
        ("portfolio_proxy.enabled", False),
        ("portfolio_proxy.enabled", "yes"),
        ("ewma.extra", 1),
    ],
)
def test_each_fault_is_named(raw, path, value):
    section, key = path.split(".")
    raw[section][key] = value
    with pytest.raises(INVALID):
        build_config(raw)


def test_closed_document(raw):
    for change in (lambda r: r.pop("garch"), lambda r: r.update(more={}), lambda r: r["garch"].pop("retry_count"), lambda r: r["experiment"].update(output_dir=r["experiment"]["input_run_dir"])):
        broken = copy.deepcopy(raw)
        change(broken)
        with pytest.raises(INVALID):
            build_config(broken)


def test_names_are_upper_cased_and_weights_keep_instrument_order(raw):
    raw["upstream"]["instruments"] = ["bb", " aa "]
    c = build_config(raw)
    assert c.upstream.instruments == ("BB", "AA") and [k for k, _ in c.portfolio_proxy.weights] == ["BB", "AA"]


def test_unreadable_file(tmp_path):
    with pytest.raises(INVALID):
        load_config(tmp_path / "none.toml")
    Path(tmp_path / "bad.toml").write_text("a = ")
    with pytest.raises(INVALID):
        load_config(tmp_path / "bad.toml")


def test_codes():
    assert len(CODES) == 20 and str(fail("OUTPUT_COLLISION", "x")) == "OUTPUT_COLLISION: x"
