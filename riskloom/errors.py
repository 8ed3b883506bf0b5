"""Typed failures. Every expected failure has a code; the command line prints `CODE: message`."""

from __future__ import annotations

# The error codes that callers and scripts match on.
CODES = (
    "CONFIG_INVALID",
    "UPSTREAM_PACKAGE_MISSING",
    "UPSTREAM_VERSION_INCOMPATIBLE",
    "UPSTREAM_MANIFEST_INVALID",
    "UPSTREAM_SCHEMA_INCOMPATIBLE",
    "UPSTREAM_QUALITY_GATE_FAILED",
    "INPUT_DATE_DUPLICATE",
    "INPUT_DATE_UNSORTED",
    "INPUT_VALUE_INVALID",
    "INSUFFICIENT_HISTORY",
    "WINDOW_ALIGNMENT_ERROR",
    "MODEL_FIT_FAILED",
    "MODEL_FORECAST_FAILED",
    "NONSTATIONARY_PARAMETERS",
    "INVALID_STUDENT_T_DOF",
    "NONFINITE_VARIANCE",
    "NONPOSITIVE_VARIANCE",
    "COVERAGE_TEST_UNDEFINED",
    "OUTPUT_COLLISION",
    "ARTIFACT_RECONCILIATION_FAILED",
)


class RiskError(Exception):
    """An expected failure with a code from CODES."""

    code = ""

    def __init__(self, message: str) -> None:
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return f"{self.code}: {self.message}"


BY_CODE: dict[str, type[RiskError]] = {}
for _code in CODES:
    _name = "".join(word.capitalize() for word in _code.split("_"))
    _name += "" if _name.endswith("Error") else "Error"
    BY_CODE[_code] = globals()[_name] = type(_name, (RiskError,), {"code": _code})


def fail(code: str, message: str) -> RiskError:
    return BY_CODE[code](message)
