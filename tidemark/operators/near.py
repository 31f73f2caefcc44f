"""Windows of which each row needs an order or a transform: rank correlation and blur over wide spans.

Series are cut into blocks of bounded size that also get the rows around them,
and a task works on a block at a time, in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, helper_names, present
from .blur import gaussian_weights


def _in_blocks(df: DataFrame, x: ColumnLike, series: Series, out: str, rows: int, before: int, after: int, row: str | None, work: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Adds what ``work(values, first, count)`` gives for count rows of a block from the place first of its values.

    values: the block's rows with ``before`` and ``after`` more around them, NaN
    where a value is missing or none is there.  row: a column of places from 0, if
    the table has one; otherwise a series is numbered by one task.
    """
    names, t = [*(c for c in df.columns if c != out), out], helper_names(df)
    place = F.col(row) if row else F.row_number().over(series.ordered) - 1
    step = df.withColumns({t("v"): F.coalesce(present(x), F.lit(math.nan)), t("i"): place.cast("bigint")})
    # A row goes to its own block and to those for which it is around.
    home = F.sequence(F.greatest(F.floor((F.col(t("i")) - after) / rows), F.lit(0)), F.floor((F.col(t("i")) + before) / rows))
    spread = step.withColumn(t("home"), F.explode(home))
    made = df.select(*(c for c in names if c != out)).schema.add(out, "double")
    v, i, home = t("v"), t("i"), t("home")

    def run(table: pa.Table) -> pa.Table:
        at, block = table.column(i).to_numpy(), table.column(home)[0].as_py()
        own = np.flatnonzero(at // rows == block)
        if not len(own):
            return table.slice(0, 0).select(names[:-1]).append_column(out, pa.array([], pa.float64()))
        first = block * rows - before
        values = np.full(before + rows + after, np.nan)
        values[at - first] = table.column(v).to_numpy()
        found = work(values, before, rows)[at[own] - block * rows]
        return table.take(own).select(names[:-1]).append_column(out, pa.array(found, pa.float64(), mask=np.isnan(found)))

    return spread.groupBy(*series.keys, t("home")).applyInArrow(lambda table: run(table), made)


class _Ranks:
    """A sliding window's sum of age times rank, in logarithmic time a step.

    A Fenwick tree over the values' order holds, packed in one number, how many
    rows are in the window below each place and the sum of their times.
    """

    SHIFT = 48
    MASK = (1 << SHIFT) - 1

    def __init__(self, size: int):
        self.tree, self.size = [0] * (size + 1), size

    def add(self, place: int, value: int) -> None:
        tree, size, place = self.tree, self.size, place + 1
        while place <= size:
            tree[place] += value
            place += place & -place

    def below(self, place: int) -> int:
        tree, total = self.tree, 0
        while place:
            total += tree[place]
            place &= place - 1
        return total


def rank_sums(values: np.ndarray, period: int) -> np.ndarray:
    """For each full window of present values the sum of age times rank; rank 0 is the largest, of equals the latest."""
    n = len(values)
    out = np.full(n, -1, np.int64)
    order = np.lexsort((-np.arange(n), -values))
    places = np.empty(n, np.int64)
    places[order] = np.arange(n)
    places = places.tolist()
    ranks, shift, mask = _Ranks(n), _Ranks.SHIFT, _Ranks.MASK
    add, below = ranks.add, ranks.below
    total, count, times = 0, 0, 0
    for now in range(n):
        if count == period:
            old = now - period
            under = below(places[old] + 1)
            rank = (under >> shift) - 1
            # Those behind it move one rank up: their ages at the time before go.
            total -= (period - 1) * rank + (count - rank - 1) * (now - 1) - (times - (under & mask))
            add(places[old], -(1 << shift) - old)
            count, times = count - 1, times - old
        total += count * (count - 1) // 2  # all grow older by one
        under = below(places[now])
        total += (count - (under >> shift)) * now - (times - (under & mask))
        add(places[now], (1 << shift) + now)
        count, times = count + 1, times + now
        if count == period:
            out[now] = total
    return out


def wide_rci(df: DataFrame, x: ColumnLike, series: Series, period: int, *, row: str | None = None, rows_per_block: int | None = None, out: str = "rci") -> DataFrame:
    """Adds rci, in time that grows with the logarithm of the period.

    row: the column of places, of a table from with_blocks; then no task sees more than a block.
    """
    if period < 2:
        raise ValueError("period must be at least 2")
    scale = float(period * (period * period - 1))
    squares = (period - 1) * period * (2 * period - 1) // 6

    def work(values: np.ndarray, first: int, count: int) -> np.ndarray:
        found = np.full(len(values), np.nan)
        there = ~np.isnan(values)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], there, [False]]).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # runs without a gap
            if end - start >= period:
                sums = rank_sums(values[start:end], period)
                apart = 2 * squares - 2 * sums
                found[start:end] = np.where(sums >= 0, (1.0 - 6.0 * apart / scale) * 100.0, np.nan)
        return found[first : first + count]

    return _in_blocks(df, x, series, out, rows_per_block or max(4096, 4 * period), period - 1, 0, row, work)


def blurred(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted mean around each value over those present, by transforms of values and of their mask.

    Where a transform would lose digits (few weights near, or values of very
    different size) the sum is made directly.
    """
    reach, there = len(weights) // 2, ~np.isnan(values)
    plain = np.where(there, values, 0.0)
    if not np.isfinite(plain).all():
        with np.errstate(invalid="ignore", divide="ignore"):
            top, bottom = np.convolve(plain, weights, "same"), np.convolve(there.astype(float), weights, "same")
            return np.where(bottom > 0, top / bottom, np.nan)
    size = 1 << (len(values) + len(weights)).bit_length()
    kernel = np.fft.rfft(weights, size)
    top, bottom = (np.fft.irfft(np.fft.rfft(a, size) * kernel, size)[reach : reach + len(values)] for a in (plain, there.astype(float)))
    with np.errstate(invalid="ignore", divide="ignore"):
        made = top / bottom
    lost = 1e-16 * size.bit_length() * np.abs(plain).max(initial=0.0)
    poor = (bottom < 1e-5) | ~(lost / np.maximum(bottom, 1e-300) < 1e-10 * np.maximum(1.0, np.abs(made)))
    padded, mask = np.pad(plain, reach), np.pad(there.astype(float), reach)
    for k in np.flatnonzero(poor).tolist():
        low = mask[k : k + 2 * reach + 1] @ weights
        made[k] = padded[k : k + 2 * reach + 1] @ weights / low if low > 0 else np.nan
    return made


def wide_gaussian_blur(df: DataFrame, x: ColumnLike, sigma: float, series: Series, *, row: str | None = None, rows_per_block: int | None = None, out: str = "blur") -> DataFrame:
    """Adds gaussian_blur, in time that sigma hardly enters.

    row: the column of places, of a table from with_blocks; then no task sees more than a block.
    """
    reach = max(1, math.ceil(9 * sigma))
    weights = np.array(gaussian_weights(sigma, reach))

    def work(values: np.ndarray, first: int, count: int) -> np.ndarray:
        return blurred(values, weights)[first : first + count]

    return _in_blocks(df, x, series, out, rows_per_block or max(4096, 4 * reach), reach, reach, row, work)
