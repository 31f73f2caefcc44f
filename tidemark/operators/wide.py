"""Moving sums, moments and extremes over wide spans, in time that the span does not enter.

Spark aggregates a sliding frame anew for each row.  Here rows are cut into
blocks of one span: a window is the end of one block and the beginning of the
next, so two running aggregates and one look back make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, checked_span, helper_names, present


def _joined(df: DataFrame, x: ColumnLike, span: int, series: Series, aggregate, join, out: str, partial: bool) -> DataFrame:
    names, t = [*(c for c in df.columns if c != out), out], helper_names(df)
    step = df.withColumns({t("v"): present(x), t("i"): F.row_number().over(series.ordered) - 1})
    step = step.withColumn(t("b"), F.floor(F.col(t("i")) / checked_span(span)))
    inner = Window.partitionBy(*series.keys, t("b")).orderBy(t("i"))
    head = inner.rowsBetween(Window.unboundedPreceding, 0)
    # Read backwards: a frame to the end would be aggregated anew for each row.
    tail = Window.partitionBy(*series.keys, t("b")).orderBy(F.col(t("i")).desc()).rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumns({t("head"): aggregate(t("v")).over(head), t("head_n"): F.count(t("v")).over(head), t("tail"): aggregate(t("v")).over(tail), t("tail_n"): F.count(t("v")).over(tail)})
    back = lambda c: F.lag(c, span - 1).over(series.ordered)
    whole = F.col(t("i")) % span == span - 1  # the window is the block itself
    value = F.when(whole, F.col(t("head"))).otherwise(join(F.col(t("head")), F.coalesce(back(t("tail")), F.lit(None).cast("double"))))
    count = F.when(whole, F.col(t("head_n"))).otherwise(F.col(t("head_n")) + F.coalesce(back(t("tail_n")), F.lit(0)))
    wanted = F.least(F.col(t("i")) + 1, F.lit(span)) if partial else F.lit(span)
    return step.withColumn(out, F.when(count == wanted, value)).select(*names)


def _sum(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0.0))


def wide_msum(df: DataFrame, x: ColumnLike, span: int, series: Series, *, out: str = "msum") -> DataFrame:
    """Adds msum."""
    return _joined(df, x, span, series, F.sum, _sum, out, False)


def wide_ma(df: DataFrame, x: ColumnLike, span: int, series: Series, *, out: str = "ma") -> DataFrame:
    """Adds ma."""
    return wide_msum(df, x, span, series, out=out).withColumn(out, F.col(out) / span)


def wide_mmax(df: DataFrame, x: ColumnLike, span: int, series: Series, *, out: str = "mmax") -> DataFrame:
    """Adds mmax."""
    return _joined(df, x, span, series, F.max, F.greatest, out, True)


def wide_mmin(df: DataFrame, x: ColumnLike, span: int, series: Series, *, out: str = "mmin") -> DataFrame:
    """Adds mmin."""
    return _joined(df, x, span, series, F.min, F.least, out, True)


def wide_moments(df: DataFrame, x: ColumnLike, span: int, series: Series, *, mean: str, var: str, ddof: int = 1) -> DataFrame:
    """Adds the mean and variance of the last ``span`` values; NULL as in ma and mvar.

    A window's number, mean and sum of squares about it are merged from those of
    the end of one block and the beginning of the next, so nothing cancels however
    far the values lie from zero.
    """
    names, t = [*(c for c in df.columns if c not in (mean, var)), mean, var], helper_names(df)
    step = df.withColumns({t("v"): present(x), t("i"): F.row_number().over(series.ordered) - 1})
    step = step.withColumn(t("b"), F.floor(F.col(t("i")) / checked_span(span)))
    block = Window.partitionBy(*series.keys, t("b"))
    made = {}
    for name, order in (("head", F.col(t("i"))), ("tail", F.col(t("i")).desc())):
        frame = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        made |= {t(f"{name}_n"): F.count(t("v")).over(frame), t(f"{name}_mean"): F.avg(t("v")).over(frame), t(f"{name}_var"): F.var_pop(t("v")).over(frame)}
    step = step.withColumns(made)
    step = step.withColumns({t(f"back_{c}"): F.lag(t(f"tail_{c}"), span - 1).over(series.ordered) for c in ("n", "mean", "var")})
    alone = F.col(t("i")) % span == span - 1  # the window is the block itself
    n = F.when(alone, F.col(t("head_n"))).otherwise(F.col(t("head_n")) + F.coalesce(t("back_n"), F.lit(0)))
    apart = F.col(t("head_mean")) - F.col(t("back_mean"))
    share = F.col(t("head_n")) / span
    joined_mean = F.col(t("back_mean")) + apart * share
    joined_var = F.col(t("head_var")) * share + F.col(t("back_var")) * (1 - share) + apart * apart * share * (1 - share)
    full = n == span
    middle = F.when(full, F.when(alone, F.col(t("head_mean"))).otherwise(joined_mean))
    spread = F.when(full & F.lit(span > ddof), F.when(alone, F.col(t("head_var"))).otherwise(joined_var) * F.lit(span / max(span - ddof, 1)))
    return step.withColumns({mean: middle, var: spread}).select(*names)


def wide_mvar(df: DataFrame, x: ColumnLike, span: int, series: Series, *, ddof: int = 1, out: str = "mvar") -> DataFrame:
    """Adds mvar."""
    t = helper_names(df)
    return wide_moments(df, x, span, series, mean=t("mean"), var=out, ddof=ddof).drop(t("mean"))


def wide_mstd(df: DataFrame, x: ColumnLike, span: int, series: Series, *, ddof: int = 1, out: str = "mstd") -> DataFrame:
    """Adds mstd."""
    return wide_mvar(df, x, span, series, ddof=ddof, out=out).withColumn(out, F.sqrt(out))


def wide_bollinger_band(df: DataFrame, x: ColumnLike, series: Series, window: int = 20, sigma: float = 2.0) -> DataFrame:
    """Adds ``upper, middle, lower`` as bollinger_band has them."""
    t = helper_names(df)
    made = wide_moments(df, x, window, series, mean="middle", var=t("var"), ddof=0)
    width = F.sqrt(t("var")) * F.lit(float(sigma))
    return made.withColumns({"upper": F.col("middle") + width, "lower": F.col("middle") - width}).drop(t("var"))
