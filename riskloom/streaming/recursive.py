"""The recursive models on a stream of returns: one state per series, updated in date order.

An extension of the batch paths: the same step functions run in a stateful operator, whose
state is the variance and the number of returns so far. Returns of a series must arrive in
date order from batch to batch; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.models import checked_variance, ewma_step
from riskloom.session import importable

OUTPUT = "series_id string, date date, variance double"
STATE = "seen int, variance double, first array<double>"


def ewma_stream(returns: DataFrame, decay: float, first: int) -> DataFrame:
    """returns(series_id, date, simple_return), streaming, to (series_id, date, variance)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, variance, start = state.get if state.exists else (0, None, [])
        start, out = list(start), []
        rows = pd.concat(list(batches)).sort_values("date")
        for day, r in zip(rows["date"], rows["simple_return"].tolist(), strict=True):
            seen += 1
            if seen <= first:
                start.append(r)
                if seen == first:
                    variance, start = checked_variance(float(np.var(start, ddof=1))), []
            else:
                variance = checked_variance(ewma_step(variance, r, decay))
            if variance is not None:
                out.append((key[0], day, variance))
        state.update((seen, variance, start))
        yield pd.DataFrame(out, columns=["series_id", "date", "variance"])

    importable(returns.sparkSession)
    return returns.groupBy("series_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
