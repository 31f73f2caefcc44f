"""Indicators of O(1) state per key over a stream, row by row in event order.

Rows of a micro-batch are ordered by event time and tie-breaker.  Rows that come
after later ones of their key are dropped, uncounted, as a recursion can't take
them back, and so are rows without a time or tie-breaker.  A key's state, five
numbers, stays for good: keys that end for ever are never forgotten.  Each row is
a step of Python, since the next one needs its result; a batch's rows of a key are
one task's.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

#: State of a key: last event time (microseconds) and tie-breaker, then two sums.
_STATE = "last_time bigint, last_tie bigint, top double, bottom double, broken boolean"


def _running(stream: DataFrame, key: str, time: str, tie: str, x: str, step, out: str) -> DataFrame:
    rows = stream.select(key, time, tie, x).dropna(subset=[time, tie])
    schema = T.StructType(list(rows.schema.fields)).add(out, "double")

    def run(keys, batches, state):
        last_time, last_tie, top, bottom, broken = state.get if state.exists else (-(1 << 62), -(1 << 62), 0.0, 0.0, False)
        part = pd.concat(list(batches)).sort_values([time, tie], kind="stable")
        kept, values = [], []
        for at, (when, order, value) in enumerate(zip(part[time], part[tie], part[x], strict=True)):
            place = (int(when.value // 1000), int(order))
            if place <= (last_time, last_tie):
                continue
            last_time, last_tie = place
            missing = value is None or math.isnan(value)
            top, bottom, broken, result = step(top, bottom, broken, None if missing else float(value))
            kept.append(at)
            values.append(result)
        state.update((last_time, last_tie, top, bottom, broken))
        yield part.iloc[kept].assign(**{out: pd.array(values, "Float64")})

    return rows.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def running_ema(stream: DataFrame, key: str, time: str, tie: str, x: str, alpha: float, *, out: str = "ema") -> DataFrame:
    """``key, time, tie, x, ema``: the bias-corrected average; null from the first missing value on."""
    rate = 1.0 - alpha

    def step(top, bottom, broken, value):
        if broken or value is None:
            return top, bottom, True, None
        top, bottom = top * rate + value, bottom * rate + 1.0
        return top, bottom, False, top / bottom

    return _running(stream, key, time, tie, x, step, out)


def running_sum(stream: DataFrame, key: str, time: str, tie: str, x: str, *, out: str = "sum") -> DataFrame:
    """``key, time, tie, x, sum``: the sum of present values; null where the value is missing."""

    def step(top, bottom, broken, value):
        if value is None:
            return top, bottom, broken, None
        return top + value, bottom, broken, top + value

    return _running(stream, key, time, tie, x, step, out)
