"""Sliding decomposition of streams: each series' latest values are fitted again as they arrive.

Beyond what the engine computes on tables. State is the last `keep` values of a series, so it is
bounded; late values older than these are dropped, and so is a value that repeats a known t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lagweave.kernels import decompose as D
from lagweave.kernels import forecast as P
from lagweave.kernels.trajectory import Block, Trajectory

OUTPUT = "series_id string, t long, trend double, forecast double"
STATE = "t array<long>, value array<double>"


def sliding_trend(stream: DataFrame, window: int, rank: int, keep: int) -> DataFrame:
    """(series_id, t, trend, forecast) once per series and micro-batch: the smoothed latest value and
    the next one. Series that span fewer than 2 * window places wait; holes between values are gaps,
    however long, and get no forecast."""
    if keep < 2 * window:
        raise ValueError("keep at least two windows")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], [])
        values = dict(zip(*map(list, old), strict=True))
        for pdf in batches:
            for t, v in zip(pdf["t"].tolist(), pdf["value"].tolist(), strict=True):
                values.setdefault(int(t), float("nan") if v is None else float(v))
        last = sorted(values)[-keep:]
        state.update((last, [values[t] for t in last]))
        # A hole of a window or more has no complete window in it, however long: so much is kept of it.
        at = np.concatenate([[0], np.cumsum(np.minimum(np.diff(last), window))])
        x = np.full(at[-1] + 1, np.nan)
        x[at] = [values[t] for t in last]
        if len(x) < 2 * window:
            return
        try:
            fit = D.basic(Trajectory([Block(x, np.ones(window, bool), (False,))]), rank)
            trend = fit.series(range(1, len(fit.sigma) + 1))[0][-1]
            ahead = P.recurrent(fit, range(1, len(fit.sigma) + 1), 1)[0][0] if not fit.x.shaped else np.nan
        except ValueError:  # no complete window, or no recurrence
            return
        yield pd.DataFrame({"series_id": [key[0]], "t": [last[-1]], "trend": [trend], "forecast": [ahead]})

    rows = stream.select("series_id", "t", "value")
    return rows.groupBy("series_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
