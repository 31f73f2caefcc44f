"""Moving windows.  Trailing, NULL until the window is full and where it holds a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, checked_span, present


def _full(value: Column, x: Column, span: int, series: Series) -> Column:
    return F.when(F.count(x).over(series.trailing(span)) == span, value)


def msum(x: ColumnLike, span: int, series: Series) -> Column:
    """Sum of the last ``span`` values."""
    v = present(x)
    return _full(F.sum(v).over(series.trailing(checked_span(span))), v, span, series)


def ma(x: ColumnLike, span: int, series: Series) -> Column:
    """Mean of the last ``span`` values."""
    v = present(x)
    return _full(F.avg(v).over(series.trailing(checked_span(span))), v, span, series)


def mvar(x: ColumnLike, span: int, series: Series, ddof: int = 1) -> Column:
    """Variance of the last ``span`` values, divided by ``span - ddof``; NULL where that isn't positive."""
    checked_span(span)
    if span <= ddof:
        return F.lit(None).cast("double")
    v = present(x)
    population = F.var_pop(v).over(series.trailing(span))
    return _full(population * F.lit(span / (span - ddof)), v, span, series)


def mstd(x: ColumnLike, span: int, series: Series, ddof: int = 1) -> Column:
    """Square root of mvar."""
    return F.sqrt(mvar(x, span, series, ddof))


def _unbroken(value: Column, v: Column, span: int, series: Series) -> Column:
    w = series.trailing(span)
    return F.when(F.count(v).over(w) == F.count(F.lit(1)).over(w), value)


def mmax(x: ColumnLike, span: int, series: Series) -> Column:
    """Largest of the last ``span`` values, from the first row on; NULL where one is missing."""
    v = present(x)
    return _unbroken(F.max(v).over(series.trailing(checked_span(span))), v, span, series)


def mmin(x: ColumnLike, span: int, series: Series) -> Column:
    """Smallest of the last ``span`` values, from the first row on; NULL where one is missing."""
    v = present(x)
    return _unbroken(F.min(v).over(series.trailing(checked_span(span))), v, span, series)


def bollinger_band(x: ColumnLike, series: Series, window: int = 20, sigma: float = 2.0) -> dict[str, Column]:
    """Mean of the window and ``sigma`` population deviations above and below it."""
    middle, width = ma(x, window, series), mstd(x, window, series, ddof=0) * F.lit(float(sigma))
    return {"upper": middle + width, "middle": middle, "lower": middle - width}


def rci(x: ColumnLike, series: Series, period: int = 9) -> Column:
    """Rank correlation of the last ``period`` values with time, from -100 to 100.

    Of equal values the more recent ranks first.  A window with a missing value
    gives NULL.
    """
    if period < 2:
        raise ValueError("period must be at least 2")
    v = present(x)
    newest_first = F.reverse(F.collect_list(v).over(series.trailing(period)))

    def squared(value: Column, age: Column) -> Column:
        ahead = F.size(F.filter(newest_first, lambda other, k: (other > value) | ((other == value) & (k < age))))
        return (age - ahead) * (age - ahead)

    total = F.aggregate(F.transform(newest_first, squared), F.lit(0), lambda a, b: a + b)
    return _full((F.lit(1.0) - F.lit(6.0) * total / F.lit(float(period * (period * period - 1)))) * 100.0, v, period, series)
