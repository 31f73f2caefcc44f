"""Small series from lists, results back as lists."""

import math

from pyspark.sql import DataFrame, SparkSession

from tidemark.series import Series

NAN, INF = math.nan, math.inf
ONE = Series(["k"], ["pos"])


def series(spark: SparkSession, *rows: list, y: list | None = None) -> DataFrame:
    """Each list is a series k; y a second column of the first."""
    data = [(k, pos, None if x is None else float(x), float(y[pos]) if y and y[pos] is not None else None) for k, row in enumerate(rows) for pos, x in enumerate(row)]
    return spark.createDataFrame(data, "k int, pos int, x double, y double")


def column(df: DataFrame, name: str = "out") -> list:
    return [r[name] for r in df.orderBy("k", "pos").collect()]


def same(got: list, want: list, tolerance: float = 1e-9) -> bool:
    if len(got) != len(want):
        return False
    for a, b in zip(got, want, strict=True):
        if (a is None) != (b is None):
            return False
        if a is not None and a != b and not abs(a - b) <= tolerance * max(1, abs(b)):
            return False
    return True
