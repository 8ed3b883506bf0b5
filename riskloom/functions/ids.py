"""Canonical JSON and deterministic ids, in Python and as column expressions.

The ids hash canonical JSON: keys sorted, no spaces, dates as ISO timestamps at midnight.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.errors import fail

# Prefixes, length and declared fields of the ids.
FIT_PREFIX, FORECAST_PREFIX, HEX_DIGITS = "fit_", "fcst_", 24
FIT_FIELDS = ("experiment_id", "series_id", "model_id", "fit_origin", "train_start", "train_end", "upstream_simple_return_checksum", "forecasting_package_version")
FORECAST_FIELDS = ("experiment_id", "fit_id", "series_id", "model_id", "forecast_origin", "target_date")


def _plain(value: Any) -> Any:
    match value:
        case None | bool() | str() | int():
            return value
        case float():
            if not math.isfinite(value):
                raise fail("CONFIG_INVALID", "An identifier can't hold a number that is not finite.")
            return value
        case datetime() | date():
            return value.isoformat()
        case Path():
            return str(value)
        case Mapping():
            return {str(k): _plain(v) for k, v in value.items()}
        case list() | tuple():
            return [_plain(v) for v in value]
    raise fail("CONFIG_INVALID", f"An identifier can't hold a {type(value).__name__}.")


def canonical_json(material: Mapping[str, Any]) -> str:
    return json.dumps(_plain(material), sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def deterministic_id(prefix: str, material: Mapping[str, Any]) -> str:
    if not prefix:
        raise fail("CONFIG_INVALID", "An identifier needs a prefix.")
    return prefix + hashlib.sha256(canonical_json(material).encode()).hexdigest()[:HEX_DIGITS]


def _material(values: Mapping[str, Column]) -> Column:
    """The same JSON as canonical_json, built by Spark."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def midnight(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd'T'00:00:00")


def id_column(prefix: str, values: Mapping[str, Column]) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_material(values), 256), 1, HEX_DIGITS))


def fit_id(experiment_id: str, checksum: str, version: str, series: Column, model: Column, origin: Column, start: Column, end: Column) -> Column:
    values = (F.lit(experiment_id), series, model, midnight(origin), midnight(start), midnight(end), F.lit(checksum), F.lit(version))
    return id_column(FIT_PREFIX, dict(zip(FIT_FIELDS, values, strict=True)))


def forecast_id(experiment_id: str, fit: Column, series: Column, model: Column, origin: Column, target: Column) -> Column:
    values = (F.lit(experiment_id), fit, series, model, midnight(origin), midnight(target))
    return id_column(FORECAST_PREFIX, dict(zip(FORECAST_FIELDS, values, strict=True)))
