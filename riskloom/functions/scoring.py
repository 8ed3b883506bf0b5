"""Scores, exceptions and likelihood terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric names, and for each tail its metric, columns and levels.
VARIANCE_METRICS = ("qlike", "squared_error", "absolute_error")
TAILS = (
    ("pinball_loss_0_05", "return_quantile_0_05", "var_0_95", 0.95, 0.05),
    ("pinball_loss_0_01", "return_quantile_0_01", "var_0_99", 0.99, 0.01),
)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def qlike(variance: Column, realized: Column) -> Column:
    return F.log(variance) + realized / variance


def squared_error(variance: Column, realized: Column) -> Column:
    return (realized - variance) * (realized - variance)


def absolute_error(variance: Column, realized: Column) -> Column:
    return F.abs(realized - variance)


def pinball(quantile: Column, realized: Column, tail: float | Column) -> Column:
    """(tail - [r < q]) * (r - q), with a strict comparison."""
    tail = F.lit(tail) if isinstance(tail, float) else tail
    return (tail - F.when(realized < quantile, 1.0).otherwise(0.0)) * (realized - quantile)


def exception(loss: Column, var: Column) -> Column:
    """A loss strictly over the value at risk; a negative value at risk is an error."""
    return F.when(var < 0, F.raise_error(F.lit("WINDOW_ALIGNMENT_ERROR: a value at risk is negative")).cast("boolean")).otherwise(loss > var)


def loss_quantile(quantile: Column) -> Column:
    """The value at risk that a return quantile implies: never negative."""
    return F.when(quantile.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), -quantile))


def bernoulli(successes: Column, trials: Column, p: Column) -> Column:
    """Log likelihood; a term without events counts as zero even where its log is not finite."""
    hit = F.when(successes == 0, 0.0).otherwise(successes * F.log(p))
    miss = F.when(trials == successes, 0.0).otherwise((trials - successes) * F.log(F.lit(1.0) - p))
    return hit + miss


def likelihood_ratio(null: Column, alternative: Column) -> Column:
    return F.greatest(F.lit(0.0), -2.0 * (null - alternative))
