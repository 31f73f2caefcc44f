"""Grouping, sorting and user functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scans import stable_rank
from ..series import ColumnLike, Series, as_column, held, helper_names, join_keys, missing
from .ranges import with_places


def reduce_nan_patterns(df: DataFrame, x: ColumnLike, *, position: str, ref: str | list[str], all_others: bool = False, keys: list[str] | None = None, out: str = "mask") -> DataFrame:
    """``keys, position, mask``: whether every ref has a present value there, in any (or all) of its other rows."""
    keys = list(keys or [])
    refs, t = [ref] if isinstance(ref, str) else list(ref), helper_names(df)
    there = ~missing(x)
    by_ref = df.groupBy(*keys, position, *refs).agg((F.bool_and(there) if all_others else F.bool_or(there)).alias(t("there")))
    return by_ref.groupBy(*keys, position).agg(F.bool_and(t("there")).alias(out))


def skipna(df: DataFrame, operator: Callable[[Series], Column], *inputs: ColumnLike, series: Series, out: str) -> DataFrame:
    """Adds what the operator gives over the rows where all inputs are present; NULL elsewhere.

    The operator gets the series of those rows and returns a column.
    """
    t = helper_names(df)
    whole = F.lit(True)
    for x in inputs:
        whole = whole & ~missing(x)
    marked = df.withColumn(t("whole"), whole)
    inner = Series([*series.keys, t("whole")], series.order_by)
    return marked.withColumn(out, F.when(F.col(t("whole")), operator(inner))).drop(t("whole"))


def _counted(df: DataFrame, x: str, keys: list[str], t: Callable[[str], str]) -> DataFrame:
    """``keys, value, n`` of the whole numbers."""
    value = F.col(x).cast("bigint")
    return df.where(value.isNotNull()).groupBy(*keys, value.alias(t("value"))).agg(F.count(F.lit(1)).alias(t("n")))


def _widths(df: DataFrame, x: str, minlength: int, t: Callable[[str], str]) -> DataFrame:
    """One row: how many bins there are; a negative number ends the job."""
    value = F.col(x).cast("bigint")
    width = F.greatest(F.max(value) + 1, F.lit(minlength)).cast("bigint")
    return df.agg(F.when(F.min(value) < 0, F.raise_error(F.lit("bincount takes no negative numbers")).cast("bigint")).otherwise(width).alias(t("width")))


def bincount(df: DataFrame, x: str, *, keys: list[str], minlength: int = 0, out: str = "n") -> DataFrame:
    """``keys, x, n``: how often each whole number from 0 to the largest of all occurs in each group.

    The width is at least ``minlength``; an empty table gives no groups.  Null
    values aren't counted, a null key is a group like others, and a negative
    number is an error.  Counts are combined before the shuffle, so a number
    that makes up half of all rows is a row a task.  The result has a row for
    each number from 0, however many there are: see bincount_ranges for wide ones.
    """
    t = helper_names(df)
    counted, width = _counted(df, x, keys, t), _widths(df, x, minlength, t)
    # One row; Spark joins it to each group without an action of its own.
    groups = df.select(*keys).distinct().join(F.broadcast(width)) if keys else width
    grid = groups.where(F.col(t("width")) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(t("width")) - 1)).alias(t("value")))
    return join_keys(grid, counted, [*keys, t("value")], "left").select(*keys, F.col(t("value")).alias(x), F.coalesce(t("n"), F.lit(0)).alias(out))


def bincount_ranges(df: DataFrame, x: str, *, keys: list[str], minlength: int = 0) -> DataFrame:
    """``keys, first, last, n``: as bincount, with runs of numbers that don't occur as one row of n = 0.

    As many rows at most as twice the different numbers, and one, a group,
    whatever the width.
    """
    t = helper_names(df)
    counted, width = _counted(df, x, keys, t), _widths(df, x, minlength, t)
    empty = join_keys(df.select(*keys).distinct(), counted.select(*keys).distinct().withColumn(t("some"), F.lit(1)), keys, "left") if keys else None
    # A number of -1 with no rows begins each group, the width itself ends it.
    begins = (empty.select(*keys) if keys else width.select()).withColumns({t("value"): F.lit(-1).cast("bigint"), t("n"): F.lit(None).cast("bigint")})
    after = F.lead(t("value")).over(Series(keys, [t("value")]).ordered)
    marked = counted.unionByName(begins).withColumn(t("after"), after).join(F.broadcast(width))
    until = F.coalesce(F.col(t("after")), F.col(t("width"))) - 1
    here = F.when(F.col(t("value")) >= 0, F.array(F.struct(F.col(t("value")).alias("first"), F.col(t("value")).alias("last"), F.col(t("n")).alias("n")))).otherwise(F.array())
    gap = F.when(until > F.col(t("value")), F.array(F.struct((F.col(t("value")) + 1).alias("first"), until.alias("last"), F.lit(0).cast("bigint").alias("n")))).otherwise(F.array())
    return marked.select(*keys, F.explode(F.concat(here, gap)).alias(t("run"))).select(*keys, *(F.col(f"{t('run')}.{c}").alias(c) for c in ("first", "last", "n")))


def group_rows(df: DataFrame, group_id: str, series: Series, *, out: str = "slot") -> DataFrame:
    """Adds the row's place within its group, in order from 0: the long form of groupby."""
    inner = Series([*series.keys, group_id], series.order_by)
    return df.withColumn(out, F.row_number().over(inner.ordered) - 1)


def padded_groups(df: DataFrame, x: str, group_id: str, series: Series, *, empty_value: float | None = None) -> DataFrame:
    """``keys, group_id, values``: arrays of equal length, one for each id from 0 to the largest.

    An array holds its whole group, so groups must be of a size that a row can
    be; group_rows has no such bound.  A null key is a key like others, rows
    without a group_id are left out, and a negative one is an error.
    """
    keys, t = list(series.keys), helper_names(df)
    kind = df.schema[group_id].dataType
    checked = F.when(F.col(group_id) < 0, F.raise_error(F.lit("group ids are at least 0")).cast(kind)).otherwise(F.col(group_id))
    order = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(series.order_by)], F.col(x).alias("x"))
    grouped = df.where(F.col(group_id).isNotNull()).groupBy(*keys, checked.alias(t("id")))
    lists = grouped.agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["x"]).alias(t("list")))
    extent = lists.agg(F.max(F.size(t("list"))).alias(t("depth")), F.max(t("id")).alias(t("last")))
    wide = lists.select(*keys).distinct().join(F.broadcast(extent)) if keys else extent.where(F.col(t("last")).isNotNull())
    grid = wide.select(*keys, t("depth"), F.explode(F.sequence(F.lit(0).cast(kind), F.col(t("last")))).alias(t("id")))
    found = F.coalesce(t("list"), F.array().cast(T.ArrayType(df.schema[x].dataType)))
    pad = F.array_repeat(F.lit(empty_value).cast(df.schema[x].dataType), F.col(t("depth")) - F.size(found))
    return join_keys(grid, lists, [*keys, t("id")], "left").select(*keys, F.col(t("id")).alias(group_id), F.concat(found, pad).alias("values"))


def stable_sort(df: DataFrame, x: ColumnLike, position: str, series: Series, *, ranges: int | None = None) -> DataFrame:
    """``keys, place, values, indices``: each series in ascending order, missing last, equals in order.

    With ranges, or without keys, series are cut into ranges of values that tasks
    sort apart, so that one series may be of any length; otherwise a task sorts
    whole series.
    """
    if series.keys and ranges is None:
        return df.select(*series.keys, stable_rank(x, series).alias("place"), held(x).alias("values"), as_column(position).alias("indices"))
    t = helper_names(df)
    marked = df.select(*series.keys, held(x).alias(t("x")), as_column(position).alias(t("position")), *(F.col(c).alias(t(f"order{k}")) for k, c in enumerate(series.order_by)))
    order = [F.col(t("x")).isNull(), F.col(t("x")), *(F.col(t(f"order{k}")) for k in range(len(series.order_by)))]
    placed = with_places(marked, list(series.keys), order, ranges=ranges, out=t("place"))
    return placed.select(*series.keys, F.col(t("place")).alias("place"), F.col(t("x")).alias("values"), F.col(t("position")).alias("indices"))


def apply_for_axis(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: T.StructType | str, series: Series) -> DataFrame:
    """Applies f to each series as an Arrow table in order; it may return any number of rows.

    A series is held by one task; for operators that need not see a whole series
    use the windows instead.
    """
    order = [(c, "ascending") for c in series.order_by]

    def run(table: pa.Table) -> pa.Table:
        return f(table.sort_by(order) if order else table)

    run.__annotations__ = {}
    return df.groupBy(*series.keys).applyInArrow(lambda table: run(table), schema)


def skipna_values(df: DataFrame, f: Callable[..., np.ndarray], *inputs: str, series: Series, out: str) -> DataFrame:
    """Adds what f gives for the rows where all inputs are present, in order; NULL elsewhere.

    f takes an array of doubles for each input, of one series' present rows, and
    returns as many values.  A series is held by one task, as in apply_for_axis;
    skipna does without that for operators over windows.
    """
    t = helper_names(df)
    columns = [c for c in df.columns if c != out]
    step = df.withColumns({t(f"x{k}"): held(F.col(x).cast("double")) for k, x in enumerate(inputs)})
    schema = df.select(*columns).schema.add(out, "double")

    def run(table: pa.Table) -> pa.Table:
        values = [table.column(t(f"x{k}")).to_numpy() for k in range(len(inputs))]
        there = ~np.any([np.isnan(v) for v in values], axis=0)
        made = np.full(table.num_rows, np.nan)
        made[there] = f(*(v[there] for v in values))
        return table.select(columns).append_column(out, pa.array(made, pa.float64(), mask=np.isnan(made)))

    return apply_for_axis(step, run, schema, series)
