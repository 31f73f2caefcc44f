"""Gaussian smoothing with weights integrated over each cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import ColumnLike, Series, divide, helper_names, present


def gaussian_weights(sigma: float, reach: int) -> list[float]:
    """Share of a normal distribution in each unit cell from -reach to reach, summing to 1."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    scale = sigma * math.sqrt(2)
    cells = [(math.erf((k + 0.5) / scale) - math.erf((k - 0.5) / scale)) / 2 for k in range(-reach, reach + 1)]
    total = sum(cells)
    return [c / total for c in cells]


def gaussian_blur(df: DataFrame, x: ColumnLike, sigma: float, series: Series, *, compat: bool = False, out: str = "blur") -> DataFrame:
    """Adds the weighted mean around each row, over the present values and renormalised at the ends.

    A missing row gets the mean of its neighbours; NULL if none has weight.
    compat: one missing value makes its whole series NULL.  Weights are zero in
    double precision beyond nine sigma, where the frame ends.
    """
    reach = max(1, math.ceil(9 * sigma))
    weights = gaussian_weights(sigma, reach)
    names, t = [*(c for c in df.columns if c != out), out], helper_names(df)
    step = df.withColumn(t("v"), present(x))
    around = series.ordered.rowsBetween(-reach, reach)
    step = step.withColumns({t("i"): F.row_number().over(series.ordered)})
    # One array of the frame's (place, value) pairs, folded with the weights by place.
    step = step.withColumn(t("near"), F.collect_list(F.struct(F.col(t("i")).alias("i"), F.col(t("v")).alias("v"))).over(around))
    table = F.array(*(F.lit(w) for w in weights))
    weight = lambda e: F.get(table, (e["i"] - F.col(t("i")) + reach).cast("int"))
    valid = F.filter(t("near"), lambda e: e["v"].isNotNull())
    top = F.aggregate(valid, F.lit(0.0), lambda a, e: a + e["v"] * weight(e))
    bottom = F.aggregate(valid, F.lit(0.0), lambda a, e: a + weight(e))
    value = divide(top, bottom)
    if compat:
        whole = F.count(t("v")).over(series.group) == F.count(F.lit(1)).over(series.group)
        value = F.when(whole, value)
    return step.withColumn(out, value).select(*names)
