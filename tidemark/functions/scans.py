"""Cumulative scans, shifts and fills along a series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, as_column, held, missing, present


def nancumsum(x: ColumnLike, series: Series) -> Column:
    """Running sum of the present values; NULL where the value is missing."""
    v = present(x)
    return F.when(v.isNotNull(), F.sum(v).over(series.upto))


def nancumprod(x: ColumnLike, series: Series) -> Column:
    """Running product of the present values; NULL where the value is missing."""
    v = present(x)
    return F.when(v.isNotNull(), F.product(v).over(series.upto))


def rcumsum(x: ColumnLike, series: Series) -> Column:
    """Sum from the row to the end; NULL where a value from there on is missing."""
    v = present(x)
    return F.when(F.count(v).over(series.since) == F.count(F.lit(1)).over(series.since), F.sum(v).over(series.since))


def rcummax(x: ColumnLike, position: ColumnLike, series: Series) -> dict[str, Column]:
    """Largest value from the row to the end, and its position; of equals the first."""
    v = present(x)
    best = F.max(F.struct(v.alias("v"), (-as_column(position)).alias("p"))).over(series.since)
    whole = F.count(v).over(series.since) == F.count(F.lit(1)).over(series.since)
    return {"values": F.when(whole, best["v"]), "indices": F.when(whole, -best["p"])}


def cumcount(x: ColumnLike, series: Series) -> Column:
    """How often the value, of any type, came before; 0 for a missing value."""
    return F.when(missing(x), F.lit(0)).otherwise(F.row_number().over(series.among(x)) - 1).cast("bigint")


def shift(x: ColumnLike, shifts: int, series: Series) -> Column:
    """The value ``shifts`` rows before, in its own type; after, if negative."""
    return F.lag(held(x), shifts).over(series.ordered)


def nanshift(x: ColumnLike, series: Series, shifts: int = 1) -> Column:
    """As shift, among the present values only; NULL where the value is missing."""
    v = held(x)
    return F.when(v.isNotNull(), F.lag(v, shifts).over(series.among(v.isNull())))


def group_shift(x: ColumnLike, mask: ColumnLike, series: Series, shifts: int = 1) -> Column:
    """As shift, among the rows whose mask is true; NULL elsewhere."""
    chosen = F.coalesce(as_column(mask), F.lit(False))
    return F.when(chosen, F.lag(held(x), shifts).over(series.among(chosen)))


def ffill(x: ColumnLike, series: Series) -> Column:
    """The last present value up to the row, in its own type."""
    return F.last(held(x), ignorenulls=True).over(series.upto)


def bfill(x: ColumnLike, series: Series) -> Column:
    """The next present value from the row on, in its own type."""
    return F.last(held(x), ignorenulls=True).over(series.since)


def stable_rank(x: ColumnLike, series: Series) -> Column:
    """The row's place when its series is sorted by value, from 0; missing values last, equals in order."""
    keys = [F.col(k) for k in series.keys]
    order = [F.col(o) for o in series.order_by]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(held(x).asc_nulls_last(), *order)) - 1
