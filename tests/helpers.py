"""A small complete input run and its configuration."""

import json
from datetime import date, timedelta
from pathlib import Path

NAMES = ["AA", "BB"]


def business_days(start: date, n: int) -> list[date]:
    days, day = [], start
    while len(days) < n:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    return days


def config_raw(top: Path) -> dict:
    return {
        "experiment": {"experiment_id": "small", "input_run_dir": str(top / "in"), "output_dir": str(top / "out"), "random_seed": 42},
        "upstream": {"project": "maker", "package_version": "1.0", "simple_returns_schema_id": "maker/returns", "simple_returns_schema_version": "1", "simple_returns_units": "decimal", "instruments": list(NAMES)},
        "periods": {"development_start": "2019-01-01", "development_end": "2019-06-30", "validation_start": "2019-07-01", "validation_end": "2019-08-31", "test_start": "2019-09-01", "test_end": "2019-12-31"},
        "portfolio_proxy": {"enabled": True, "series_id": "MIX", "weights": {"AA": 0.75, "BB": 0.25}},
        "historical": {"variance_window": 20, "var_window": 30, "quantile_method": "linear"},
        "ewma": {"lambda": 0.9, "initialization_window": 20},
        "garch": {"estimation_window": 60, "refit_every_origins": 20, "input_scale": 100.0, "retry_count": 1, "stationarity_tolerance": 1e-8},
        "evaluation": {"bootstrap_block_length": 5, "bootstrap_resamples": 50, "bootstrap_confidence": 0.9},
    }


def write_run(top: Path, n: int = 261) -> None:
    folder = top / "in"
    folder.mkdir(parents=True)
    days = business_days(date(2019, 1, 1), n)
    rows = [f"{d},{((p * 7) % 19 - 9) / 800:.10f},{((p * 5) % 23 - 11) / 900:.10f}" for p, d in enumerate(days[1:])]
    (folder / "simple_returns.csv").write_text("\n".join(["date," + ",".join(NAMES), *rows]) + "\n")
    manifest = {
        "project": "maker", "project_version": "1.0", "data_source": {"instruments": NAMES},
        "artifact_schemas": {"simple_returns.csv": {"schema_id": "maker/returns", "schema_version": "1", "units": "decimal"}},
        "estimation_conventions": {"missing_data": {"forward_fill": False}},
    }
    quality = {
        "requested_instruments": NAMES, "returned_instruments": NAMES, "common_date_count_after_alignment": n, "first_common_date": days[0].isoformat(), "last_common_date": days[-1].isoformat(),
        "duplicate_date_instrument_rows_removed": 0, "invalid_price_values_removed": 0, "common_history_rows_removed": 0,
    }
    (folder / "run_manifest.json").write_text(json.dumps(manifest))
    (folder / "data_quality_report.json").write_text(json.dumps(quality))


def edit(path: Path, change) -> None:
    raw = json.loads(path.read_text())
    change(raw)
    path.write_text(json.dumps(raw))
