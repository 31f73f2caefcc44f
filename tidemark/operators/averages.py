"""Exponential averages and the relative strength index.

An exponential average is a quotient of weighted running sums.  Their weights
grow without bound, so rows are cut into blocks over which they stay within
1e17: of earlier blocks only the last one still counts in double precision.  Two
windows over (keys, block) and one look back replace the recursion.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, divide, helper_names, join_keys, present
from .long_series import COUNT, scan_in_blocks, trailing_in_blocks

_NEGLIGIBLE = 1e-17


def _weighted(df: DataFrame, values: dict[str, Column], rate: float, series: Series, t: Callable[[str], str]) -> DataFrame:
    """For each value the sum over earlier rows of value times rate to the power of their distance.

    Rows are numbered by the helper column ``i`` from 0 within the series.
    """
    size = max(1, math.ceil(math.log(_NEGLIGIBLE) / math.log(rate))) if rate > 0 else 1
    df = df.withColumn(t("b"), F.floor(F.col(t("i")) / size)).withColumn(t("j"), F.col(t("i")) % size)
    block = Window.partitionBy(*series.keys, t("b"))
    inner = block.orderBy(t("j")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*series.keys).orderBy(t("b")).rangeBetween(-1, -1)
    grown = F.pow(F.lit(1.0 / rate), F.col(t("j")).cast("double"))
    shrunk = F.pow(F.lit(rate), F.col(t("j")).cast("double"))
    from_end = F.pow(F.lit(rate), F.lit(size - 1.0) - F.col(t("j")))
    df = df.withColumns({t(f"{k}_in"): F.sum(v * grown).over(inner) * shrunk for k, v in values.items()} | {t(f"{k}_all"): F.sum(v * from_end).over(block) for k, v in values.items()})
    carried = {t(f"{k}_before"): F.coalesce(F.first(t(f"{k}_all")).over(before), F.lit(0.0)) for k in values}
    df = df.withColumns(carried)
    return df.withColumns({k: F.col(t(f"{k}_in")) + F.col(t(f"{k}_before")) * shrunk * rate for k in values})


def _bare(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def ema(df: DataFrame, x: ColumnLike, alpha: float, series: Series, *, adjust: bool = True, out: str = "ema") -> DataFrame:
    """Adds the exponential average of rate alpha; NULL from the first missing value on.

    adjust: weights of past values are normalised, as they are from the first
    row on; otherwise the average begins at the first value and recurs.
    alpha 0 is the running mean, alpha 1 the value itself.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie from 0 to 1")
    v, t = present(x), helper_names(df)
    names = [*(c for c in df.columns if c != out), out]
    unbroken = F.count(v).over(series.upto) == F.count(F.lit(1)).over(series.upto)
    if alpha == 1:
        return _bare(df.withColumn(out, F.when(unbroken, v)), names)
    if alpha == 0:
        mean = F.avg(v) if adjust else F.first(v)
        return _bare(df.withColumn(out, F.when(unbroken, mean.over(series.upto))), names)
    rate = 1.0 - alpha
    if rate == 1.0:  # too small to weigh in double precision
        return ema(df, x, 0, series, adjust=adjust, out=out)
    step = df.withColumns({t("ok"): unbroken, t("v"): v, t("i"): F.row_number().over(series.ordered) - 1})
    if adjust:
        step = _weighted(step, {t("top"): F.coalesce(t("v"), F.lit(0.0)), t("bottom"): F.lit(1.0)}, rate, series, t)
        value = F.col(t("top")) / F.col(t("bottom"))
    else:
        # The first value has weight 1, each later one alpha.
        weight = F.when(F.col(t("i")) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        value = F.col(t("top"))
        step = _weighted(step, {t("top"): F.coalesce(t("v"), F.lit(0.0)) * weight}, rate, series, t)
    return _bare(step.withColumn(out, F.when(F.col(t("ok")), value)), names)


def rsi(df: DataFrame, x: ColumnLike, series: Series, span: int = 14, *, use_sma: bool = False, out: str = "rsi") -> DataFrame:
    """Adds the relative strength index, 100 gain / (gain + loss); NULL for the first ``span`` rows.

    Gains and losses are averaged over the last ``span`` changes (use_sma), or
    by Wilder's recursion begun with their mean.  Without any change it is 0.
    A missing value gives NULL from there on (use_sma: while it is in the window).
    """
    if span < 1:
        raise ValueError("span must be at least 1")
    names, t = [*(c for c in df.columns if c != out), out], helper_names(df)
    step = df.withColumn(t("v"), present(x)).withColumn(t("i"), F.row_number().over(series.ordered) - 1)
    step = step.withColumn(t("d"), F.col(t("v")) - F.lag(t("v")).over(series.ordered))
    step = step.withColumns({t("up"): F.greatest(t("d"), F.lit(0.0)), t("down"): F.greatest(-F.col(t("d")), F.lit(0.0))})
    w = series.trailing(span)
    if use_sma:
        step = step.withColumns({t("gain"): F.sum(t("up")).over(w), t("loss"): F.sum(t("down")).over(w), t("ok"): F.count(t("d")).over(w) == span})
    else:
        step = step.withColumn(t("ok"), (F.col(t("i")) >= span) & (F.count(t("v")).over(series.upto) == F.col(t("i")) + 1))
        rate = 1.0 - 1.0 / span
        if rate == 0:
            step = step.withColumns({t("gain"): F.col(t("up")), t("loss"): F.col(t("down"))})
        else:
            # The seed, the mean of the first changes, stands at row `span`; later changes weigh 1 / span.
            seeded = {}
            for name in ("up", "down"):
                seed = F.avg(t(name)).over(w)
                seeded[t(f"{name}_w")] = F.when(F.col(t("i")) < span, F.lit(0.0)).when(F.col(t("i")) == span, seed).otherwise(F.col(t(name)) / span)
            step = step.withColumns(seeded)
            step = _weighted(step, {t("gain"): F.coalesce(t("up_w"), F.lit(0.0)), t("loss"): F.coalesce(t("down_w"), F.lit(0.0))}, rate, series, t)
    value = F.coalesce(divide(F.lit(100.0) * F.col(t("gain")), F.col(t("gain")) + F.col(t("loss"))), F.lit(0.0))
    return _bare(step.withColumn(out, F.when(F.col(t("ok")), value)), names)


def _decayed(step: DataFrame, values: dict[str, Column], rate: float, keys: list[str], rows_per_block: int, t: Callable[[str], str]) -> DataFrame:
    """As _weighted, for the result of with_blocks: an affine map of each block carries what came before it on."""
    place = F.col("_row") % rows_per_block
    step = _weighted(step.withColumn(t("i"), place), values, rate, Series([*keys, "_block"], ["_row"]), t)
    # What a block leaves to the next: its sum at its last row, and the rate to the power of its rows.
    totals = step.groupBy(*keys, "_block").agg(*(F.max_by(name, "_row").alias(t(f"{name}_left")) for name in values))
    over_block = rate**rows_per_block
    if over_block > 1e-300:
        totals = _weighted(totals.withColumn(t("i"), F.col("_block")), {t(f"{name}_left"): F.col(t(f"{name}_left")) for name in values}, over_block, Series(keys, ["_block"]), t)
    earlier = Series(keys, ["_block"]).ordered
    carried = totals.select(*keys, "_block", *(F.coalesce(F.lag(t(f"{name}_left")).over(earlier), F.lit(0.0)).alias(t(f"{name}_carried")) for name in values))
    fade = F.pow(F.lit(rate), (place + 1).cast("double"))
    return join_keys(step, carried, [*keys, "_block"]).withColumns({name: F.col(name) + F.col(t(f"{name}_carried")) * fade for name in values})


def ema_in_blocks(blocked: DataFrame, x: ColumnLike, alpha: float, keys: list[str], *, rows_per_block: int, adjust: bool = True, out: str = "ema") -> DataFrame:
    """As ema, for the result of with_blocks: no task sees more than a block, or a row of each block, however small alpha is."""
    if not 0 < alpha < 1 or 1.0 - alpha == 1.0:
        raise ValueError("alpha must lie between 0 and 1, and 1 - alpha differ from 1")
    names, t, rate = [*(c for c in blocked.columns if c != out), out], helper_names(blocked), 1.0 - alpha
    step = scan_in_blocks(blocked, {t("gaps"): (F.when(present(x).isNull(), F.lit(1)), COUNT)}, keys)
    value = F.coalesce(present(x), F.lit(0.0))
    if not adjust:
        value = value * F.when(F.col("_row") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    step = _decayed(step, {t("top"): value}, rate, keys, rows_per_block, t)
    # The weights add up to (1 - rate^n) / alpha.
    bottom = -F.expm1(F.lit(math.log1p(-alpha)) * (F.col("_row") + 1)) / alpha if adjust else F.lit(1.0)
    return _bare(step.withColumn(out, F.when(F.col(t("gaps")) == 0, F.col(t("top")) / bottom)), names)


def rsi_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], span: int = 14, *, rows_per_block: int, out: str = "rsi") -> DataFrame:
    """As rsi by Wilder's recursion, for the result of with_blocks; the span must be smaller than a block."""
    if not 1 < span < rows_per_block:
        raise ValueError("span must lie between 1 and the rows of a block")
    names, t = [*(c for c in blocked.columns if c != out), out], helper_names(blocked)
    step = blocked.withColumn(t("v"), present(x))
    step = trailing_in_blocks(step, lambda s: F.lag(t("v")).over(s.ordered), 2, keys, rows_per_block=rows_per_block, out=t("last"))
    step = step.withColumn(t("d"), F.col(t("v")) - F.col(t("last")))
    step = step.withColumns({t("up"): F.greatest(t("d"), F.lit(0.0)), t("down"): F.greatest(-F.col(t("d")), F.lit(0.0))})
    first = Series([*keys, "_block"], ["_row"]).trailing(span)
    seeded = {}
    for name in ("up", "down"):
        seed = F.avg(t(name)).over(first)  # the seed's row lies in the first block, as do those before it
        seeded[t(f"{name}_w")] = F.when(F.col("_row") < span, F.lit(0.0)).when(F.col("_row") == span, seed).otherwise(F.col(t(name)) / span)
    step = scan_in_blocks(step.withColumns(seeded), {t("gaps"): (F.when(F.col(t("v")).isNull(), F.lit(1)), COUNT)}, keys)
    step = _decayed(step, {t("gain"): F.coalesce(t("up_w"), F.lit(0.0)), t("loss"): F.coalesce(t("down_w"), F.lit(0.0))}, 1.0 - 1.0 / span, keys, rows_per_block, t)
    value = F.coalesce(divide(F.lit(100.0) * F.col(t("gain")), F.col(t("gain")) + F.col(t("loss"))), F.lit(0.0))
    return _bare(step.withColumn(out, F.when((F.col("_row") >= span) & (F.col(t("gaps")) == 0), value)), names)
