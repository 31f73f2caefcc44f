"""Aggregates of one or two columns.

They stand in ``groupBy().agg()``, or over a window where each row should keep
its group's value.  Names with ``nan`` skip what is missing, the others give NULL
if anything is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import ColumnLike, as_column, divide, held, present


def _whole(value: Column, *columns: Column) -> Column:
    ok = F.lit(True)
    for v in columns:
        ok = ok & (F.count(v) == F.count(F.lit(1)))
    return F.when(ok, value)


def _pair(x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    vx, vy = present(x), present(y)
    both = vx.isNotNull() & vy.isNotNull()
    return F.when(both, vx), F.when(both, vy)


def nansum(x: ColumnLike) -> Column:
    return F.sum(present(x))


def nanmean(x: ColumnLike) -> Column:
    return F.avg(present(x))


def nanvar(x: ColumnLike, unbiased: bool = True) -> Column:
    return F.var_samp(present(x)) if unbiased else F.var_pop(present(x))


def nanskew(x: ColumnLike, unbiased: bool = True) -> Column:
    """Skewness; the unbiased form needs three values."""
    v = present(x)
    n, biased = F.count(v).cast("double"), F.skewness(v)
    if not unbiased:
        return F.nullif(biased, F.lit(float("nan")))
    return F.when(n >= 3, F.nullif(divide(biased * F.sqrt(n * (n - 1)), n - 2), F.lit(float("nan"))))


def nankurtosis(x: ColumnLike, unbiased: bool = True, fisher: bool = True) -> Column:
    """Kurtosis; the unbiased form needs four values.  fisher: less that of a normal distribution."""
    v = present(x)
    n, plain = F.count(v).cast("double"), F.kurtosis(v) + 3.0
    less = 3.0 if fisher else 0.0
    if not unbiased:
        return F.nullif(plain - less, F.lit(float("nan")))
    corrected = ((n + 1) * plain - less * (n - 1)) * (n - 1)
    return F.when(n >= 4, F.nullif(divide(corrected, (n - 2) * (n - 3)), F.lit(float("nan"))))


def nanmax(x: ColumnLike, position: ColumnLike) -> dict[str, Column]:
    """Largest value, in its own type, and its position, of equals the first; NULL and 0 if all are missing."""
    v = held(x)
    best = F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-as_column(position)).alias("p"))))
    return {"values": best["v"], "indices": F.coalesce(-best["p"], F.lit(0))}


def nanmin(x: ColumnLike, position: ColumnLike) -> dict[str, Column]:
    """Smallest value, in its own type, and its position, of equals the first; NULL and 0 if all are missing."""
    v = held(x)
    best = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), as_column(position).alias("p"))))
    return {"values": best["v"], "indices": F.coalesce(best["p"], F.lit(0))}


def rms(x: ColumnLike) -> Column:
    """Root of the mean square."""
    v = present(x)
    return _whole(F.sqrt(F.avg(v * v)), v)


def mulsum(x: ColumnLike, y: ColumnLike) -> Column:
    """Sum of products."""
    vx, vy = present(x), present(y)
    return _whole(F.sum(vx * vy), vx, vy)


def mulmean(x: ColumnLike, y: ColumnLike, ddof: int = 0) -> Column:
    """Sum of products over the number of rows less ddof."""
    return divide(mulsum(x, y), (F.count(F.lit(1)) - ddof).cast("double"))


def nanmulsum(x: ColumnLike, y: ColumnLike) -> Column:
    """Sum of products over pairs with both values."""
    return F.sum(present(x) * present(y))


def nanmulmean(x: ColumnLike, y: ColumnLike, ddof: int = 0) -> Column:
    product = present(x) * present(y)
    return divide(F.sum(product), (F.count(product) - ddof).cast("double"))


def _covariance(vx: Column, vy: Column, ddof: int) -> Column:
    n = F.count(vx).cast("double")
    return F.when(n > ddof, divide(F.covar_pop(vx, vy) * n, n - ddof))


def covar(x: ColumnLike, y: ColumnLike, ddof: int = 1) -> Column:
    vx, vy = present(x), present(y)
    return _whole(_covariance(vx, vy, ddof), vx, vy)


def nancovar(x: ColumnLike, y: ColumnLike, ddof: int = 1, *, compat: bool = False) -> Column:
    """Covariance over pairs with both values; exact for any pattern of missing values.

    compat: each column is centred by the mean of all its present values,
    whether or not the other is there, and the mean of products is taken off by
    the columns' own means; that is exact only where both miss the same rows.
    """
    if not compat:
        return _covariance(*_pair(x, y), ddof)
    px, py = _pair(x, y)
    n = F.count(px).cast("double")
    # How far the pairs' means lie from those of all present values.
    dx, dy = F.avg(px) - F.avg(present(x)), F.avg(py) - F.avg(present(y))
    products = divide(n * (F.covar_pop(px, py) + dx * dy), n - ddof)
    return F.when(n > ddof, products - divide(n * dx, n - ddof) * divide(n * dy, n - ddof))


def _correlation(vx: Column, vy: Column) -> Column:
    return F.nullif(divide(F.covar_pop(vx, vy), F.stddev_pop(vx) * F.stddev_pop(vy)), F.lit(float("nan")))


def correl(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation; NULL if a column is constant."""
    vx, vy = present(x), present(y)
    return _whole(_correlation(vx, vy), vx, vy)


def nancorrel(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation over pairs with both values."""
    return _correlation(*_pair(x, y))


def slope(x: ColumnLike, y: ColumnLike) -> Column:
    """Least-squares slope of y on x."""
    vx, vy = present(x), present(y)
    return _whole(F.regr_slope(vy, vx), vx, vy)


def nanslope(x: ColumnLike, y: ColumnLike) -> Column:
    """Least-squares slope of y on x over pairs with both values."""
    vx, vy = _pair(x, y)
    return F.regr_slope(vy, vx)
