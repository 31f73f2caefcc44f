"""Windows over series too long for one task.

A window puts all rows of a key into one task.  Here rows are numbered within
their key without that, cut into blocks, and blocks become keys: trailing
windows get the last rows of the block before as a halo; scans get what earlier
blocks (or later ones) fold to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, as_column, checked_span, held, helper_names, join_keys, missing, present
from .ranges import with_places


def with_blocks(df: DataFrame, order_by: str | list[str], keys: list[str], *, rows_per_block: int, slice_width: float | None = None) -> DataFrame:
    """Adds ``_row``, the place within the key from 0, and ``_block``.

    The table must have neither yet.  order_by must be unique within the key.
    Rows are cut into ranges by a sample; or, with ``slice_width``, counted in
    slices of that width of a number or timestamp, which saves the sample.  A range
    or slice, not a key, is what one task orders, so choose it to hold what a
    task can sort.
    """
    if {"_row", "_block"} & set(df.columns):
        raise ValueError("the table has a column _row or _block already")
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    if slice_width is None:
        numbered = with_places(df, keys, [F.col(c) for c in columns])
        return numbered.withColumn("_block", F.floor(F.col("_row") / rows_per_block))
    (order_by,) = columns
    t = helper_names(df)
    place = F.col(order_by).cast("double") if dict(df.dtypes)[order_by] != "timestamp_ntz" else F.unix_micros(F.col(order_by).cast("timestamp")) / 1e6
    sliced = df.withColumn(t("slice"), F.floor(place / slice_width))
    counts = sliced.groupBy(*keys, t("slice")).agg(F.count(F.lit(1)).alias(t("n")))
    before = Window.partitionBy(*keys).orderBy(t("slice")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, t("slice"), F.coalesce(F.sum(t("n")).over(before), F.lit(0)).alias(t("start")))
    inner = Window.partitionBy(*keys, t("slice")).orderBy(order_by)
    row = F.col(t("start")) + F.row_number().over(inner) - 1
    numbered = join_keys(sliced, starts, [*keys, t("slice")]).withColumn("_row", row)
    return numbered.withColumn("_block", F.floor(F.col("_row") / rows_per_block)).drop(t("slice"), t("start"))


def trailing_in_blocks(blocked: DataFrame, operator: Callable[[Series], Column], span: int, keys: list[str], *, rows_per_block: int, out: str) -> DataFrame:
    """Adds a trailing window operator to the result of with_blocks, for spans up to a block.

    The last ``span - 1`` rows of each block are also dealt to the next, and
    dropped again.
    """
    if checked_span(span) > rows_per_block:
        raise ValueError("a span must not exceed a block")
    t = helper_names(blocked)
    at_end = F.col("_row") % rows_per_block >= rows_per_block - (span - 1)
    targets = F.when(at_end, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))
    spread = blocked.withColumn(t("home"), F.explode(targets))
    made = spread.withColumn(out, operator(Series([*keys, t("home")], ["_row"])))
    return made.where(F.col(t("home")) == F.col("_block")).drop(t("home"))


@dataclass(frozen=True)
class Fold:
    """An associative fold of a series: of a block, along its rows, of blocks, and of what went before with a block's own."""

    total: Callable[[Column, Column], Column]
    along: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


def _greater(a: Column, b: Column) -> Column:
    return F.when(b.isNull() | (a > b), a).otherwise(b)


SUM = Fold(lambda v, row: F.sum(v), F.sum, F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
PRODUCT = Fold(lambda v, row: F.product(v), F.product, F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0)))
COUNT = Fold(lambda v, row: F.count(v), F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b)
MAX = Fold(lambda v, row: F.max(v), F.max, F.max, _greater)
LAST = Fold(lambda v, row: F.max_by(v, F.when(v.isNotNull(), row)), lambda v: F.last(v, ignorenulls=True), lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def scan_in_blocks(blocked: DataFrame, states: dict[str, tuple[Column, Fold]], keys: list[str], *, backwards: bool = False) -> DataFrame:
    """Adds to the result of with_blocks, for each name, the fold of a value from the series' first row (backwards: its last) to each row.

    Blocks are folded apart, their totals folded in order, and what went before a
    block is joined with the fold along its own rows: a task sees a block, or one
    row of each block.
    """
    t = helper_names(blocked)
    step = blocked.withColumns({t(f"{name}_v"): value for name, (value, _) in states.items()})
    row, block = (-F.col("_row"), F.col("_block").desc()) if backwards else (F.col("_row"), F.col("_block"))
    totals = step.groupBy(*keys, "_block").agg(*(fold.total(F.col(t(f"{name}_v")), row).alias(t(f"{name}_total")) for name, (_, fold) in states.items()))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", *(fold.merge(F.col(t(f"{name}_total"))).over(before).alias(t(f"{name}_before")) for name, (_, fold) in states.items()))
    along = Window.partitionBy(*keys, "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_keys(step, offsets, [*keys, "_block"])
    return joined.select(*blocked.columns, *(fold.join(F.col(t(f"{name}_before")), fold.along(F.col(t(f"{name}_v"))).over(along)).alias(name) for name, (_, fold) in states.items()))


def cumulative_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], *, out: str) -> DataFrame:
    """Adds nancumsum to the result of with_blocks."""
    v = present(x)
    return scan_in_blocks(blocked, {out: (v, SUM)}, keys).withColumn(out, F.when(v.isNotNull(), F.col(out)))


def nancumprod_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], *, out: str) -> DataFrame:
    """Adds nancumprod to the result of with_blocks."""
    v = present(x)
    return scan_in_blocks(blocked, {out: (v, PRODUCT)}, keys).withColumn(out, F.when(v.isNotNull(), F.col(out)))


def ffill_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], *, out: str) -> DataFrame:
    """Adds ffill to the result of with_blocks."""
    return scan_in_blocks(blocked, {out: (held(x), LAST)}, keys)


def bfill_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], *, out: str) -> DataFrame:
    """Adds bfill to the result of with_blocks."""
    return scan_in_blocks(blocked, {out: (held(x), LAST)}, keys, backwards=True)


def _unbroken(blocked: DataFrame, x: ColumnLike, value: Column, fold: Fold, keys: list[str], t: Callable[[str], str]) -> DataFrame:
    """Adds ``t("fold")`` from each row to the end, NULL where a value from there on is missing."""
    gap = F.when(missing(x), F.lit(1))
    made = scan_in_blocks(blocked, {t("fold"): (value, fold), t("gaps"): (gap, COUNT)}, keys, backwards=True)
    return made.withColumn(t("fold"), F.when(F.col(t("gaps")) == 0, F.col(t("fold")))).drop(t("gaps"))


def rcumsum_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], *, out: str) -> DataFrame:
    """Adds rcumsum to the result of with_blocks."""
    t = helper_names(blocked)
    return _unbroken(blocked, x, present(x), SUM, keys, t).withColumnRenamed(t("fold"), out)


def rcummax_in_blocks(blocked: DataFrame, x: ColumnLike, position: ColumnLike, keys: list[str], *, values: str = "values", indices: str = "indices") -> DataFrame:
    """Adds both columns of rcummax to the result of with_blocks."""
    t = helper_names(blocked)
    v, at = present(x), as_column(position)
    best = F.when(v.isNotNull(), F.struct(v.alias("v"), (-at).alias("p")))
    made = _unbroken(blocked, x, best, MAX, keys, t)
    return made.withColumns({values: F.col(t("fold"))["v"], indices: -F.col(t("fold"))["p"]}).drop(t("fold"))


def cumcount_in_blocks(blocked: DataFrame, x: ColumnLike, keys: list[str], *, out: str) -> DataFrame:
    """Adds cumcount to the result of with_blocks.

    A value's rows are numbered within a block; a value that makes up half of the
    series is as many rows for the task of the offsets as there are blocks.
    """
    t = helper_names(blocked)
    step = blocked.withColumn(t("v"), held(x))
    counts = step.where(F.col(t("v")).isNotNull()).groupBy(*keys, t("v"), "_block").agg(F.count(F.lit(1)).alias(t("n")))
    before = Window.partitionBy(*keys, t("v")).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, t("v"), "_block", F.coalesce(F.sum(t("n")).over(before), F.lit(0)).alias(t("before")))
    within = F.row_number().over(Window.partitionBy(*keys, t("v"), "_block").orderBy("_row")) - 1
    joined = join_keys(step, offsets, [*keys, t("v"), "_block"], "left")
    count = F.when(F.col(t("v")).isNull(), F.lit(0)).otherwise(F.col(t("before")) + within).cast("bigint")
    return joined.select(*blocked.columns, count.alias(out))
