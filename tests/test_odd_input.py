"""Null keys, names that clash with helpers, and values that aren't doubles."""

import datetime
from collections import Counter

import pytest
from helpers import INF, NAN, ONE, column, series
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import operators as op
from tidemark.operators.linalg import covariance, covariance_of_vectors
from tidemark.series import Series


def test_bincount_of_null_keys_and_clashing_names(spark):
    rows = [(None, 1), (None, 1), ("a", 3), ("a", None), (None, 0)]
    df = spark.createDataFrame(rows, "k string, x int")
    want = {(k, x): 0 for k in (None, "a") for x in range(4)} | {k: n for k, n in Counter(r for r in rows if r[1] is not None).items()}
    assert {(r.k, r.x): r.n for r in op.bincount(df, "x", keys=["k"]).collect()} == want
    for key, value in (("_value", "_n"), ("_n", "_width"), ("_width", "n"), ("n", "_value")):
        got = op.bincount(df.toDF(key, value), value, keys=[key], out="count").collect()
        assert {(r[key], r[value]): r["count"] for r in got} == want
    assert {r.x: r.n for r in op.bincount(df, "x", keys=[]).collect()} == {0: 1, 1: 2, 2: 0, 3: 1}
    with pytest.raises(Exception, match="negative"):
        op.bincount(spark.createDataFrame([("a", -1)], "k string, x int"), "x", keys=["k"]).collect()


def test_bincount_ranges(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 10**9), ("a", 0), ("b", None)], "k string, x bigint")
    got = {(r.k, r["first"], r["last"]): r.n for r in op.bincount_ranges(df, "x", keys=["k"]).collect()}
    assert got == {(None, 0, 0): 0, (None, 1, 1): 2, (None, 2, 10**9): 0, ("a", 0, 0): 1, ("a", 1, 10**9 - 1): 0, ("a", 10**9, 10**9): 1, ("b", 0, 10**9): 0}
    got = [(r["first"], r["last"], r.n) for r in op.bincount_ranges(df.where("k is null"), "x", keys=[], minlength=5).orderBy("first").collect()]
    assert got == [(0, 0, 0), (1, 1, 2), (2, 4, 0)]
    assert op.bincount_ranges(df.limit(0), "x", keys=["k"]).collect() == []


def test_padded_groups_of_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 1, 5.0), ("a", 1, 0, 6.0), (None, 2, 1, 7.0), ("a", 3, None, 8.0)], "k string, pos int, g int, x double")
    want = {(None, 0): [None, None], (None, 1): [5.0, 7.0], ("a", 0): [6.0, None], ("a", 1): [None, None]}
    for name in ("k", "_depth", "_list", "_last", "_id"):
        got = op.padded_groups(df.withColumnRenamed("k", name), "x", "g", Series([name], ["pos"])).collect()
        assert {(r[name], r.g): r["values"] for r in got} == want
    assert op.padded_groups(df.limit(0), "x", "g", Series([], ["pos"])).collect() == []
    with pytest.raises(Exception, match="at least 0"):
        op.padded_groups(df.withColumn("g", F.lit(-1)), "x", "g", Series(["k"], ["pos"])).collect()


def test_blocks_of_null_keys(spark):
    df = spark.createDataFrame([(k, p, float(p)) for k in (None, "a") for p in range(25)], "k string, pos int, x double")
    blocked = op.with_blocks(df, "pos", ["k"], rows_per_block=4, slice_width=10)
    made = op.cumulative_in_blocks(blocked, "x", ["k"], out="out").collect()
    assert {(r.k, r.pos): r.out for r in made} == {(k, p): p * (p + 1) / 2 for k in (None, "a") for p in range(25)}
    made = op.trailing_in_blocks(blocked, lambda s: fn.msum("x", 3, s), 3, ["k"], rows_per_block=4, out="out").collect()
    assert {(r.k, r.pos): r.out for r in made} == {(k, p): None if p < 2 else 3.0 * p - 3 for k in (None, "a") for p in range(25)}


def test_patterns_and_covariance_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 1, 1, 5.0)], "k int, pos int, ref int, x double")
    for name in ("_there", "_at", "_names", "_section", "_vector", "_near"):
        made = op.reduce_nan_patterns(df.withColumnRenamed("k", name), "x", position="pos", ref="ref", keys=[name]).collect()
        assert {(r[name], r.pos, r.mask) for r in made} == {(1, 0, True), (1, 1, True)}
        made = covariance(df.withColumnRenamed("k", name), [name], "pos", "ref", "x", skip_missing=False).collect()
        assert {(r.r, r.c): r.x for r in made} == {(0, 0): 0.5, (0, 1): 1.5, (1, 0): 1.5, (1, 1): 4.5}
        wide = df.groupBy(F.col("k").alias(name), "pos").agg(F.array_sort(F.collect_list("x")).alias("v"))
        assert covariance_of_vectors(wide, [name], "v", skip_missing=True).count() == 4


@pytest.mark.parametrize("kind, values", [("bigint", [2**53 + 1, None, 2**53 + 3, 2**53 + 1]), ("string", ["NaN", None, "b", "NaN"]), ("timestamp_ntz", [datetime.datetime(2024, 1, d) if d else None for d in (3, 0, 1, 3)]), ("float", [1.5, NAN, 0.5, 1.5]), ("array<int>", [[2], None, [1], [2]]), ("boolean", [True, None, False, True])])
def test_fills_shifts_extremes_and_counts_keep_the_type(spark, kind, values):
    df = spark.createDataFrame(list(enumerate(values)), f"pos int, x {kind}").withColumn("k", F.lit(None).cast("int"))
    a, b = values[0], values[2]
    made = df.select("k", "pos", *(c.alias(n) for n, c in {"ffill": fn.ffill("x", ONE), "bfill": fn.bfill("x", ONE), "shift": fn.shift("x", 1, ONE), "nanshift": fn.nanshift("x", ONE), "count": fn.cumcount("x", ONE)}.items()))
    assert dict(made.dtypes)["ffill"] == dict(made.dtypes)["shift"] == kind
    want = {"ffill": [a, a, b, a], "bfill": [a, b, b, a], "shift": [None, a, None, b], "nanshift": [None, None, a, b], "count": [0, 0, 0, 1]}
    assert {n: column(made, n) for n in want} == want
    ends = df.groupBy("k").agg(*(c.alias(n) for n, c in fn.nanmax("x", "pos").items()), *(c.alias(f"least_{n}") for n, c in fn.nanmin("x", "pos").items())).collect()[0]
    most, least = (a, b) if a > b else (b, a)
    assert (ends["values"], ends.least_values) == (most, least)
    ordered = op.stable_sort(df, "x", "pos", ONE).orderBy("place").collect()
    assert [r["values"] for r in ordered] == [*sorted([a, b, a]), None] and ordered[-1].indices == 1


def test_frames_to_the_end(spark):
    df = series(spark, [1, NAN, 3, 2], [INF, 1, 5])
    assert column(df.withColumn("out", fn.rcumsum("x", ONE))) == [None, None, 5, 2, INF, 6, 5]
    best = fn.rcummax("x", "pos", ONE)
    assert column(df.withColumn("out", best["values"])) == [None, None, 3, 2, INF, 5, 5]
    assert column(df.withColumn("out", best["indices"])) == [None, None, 2, 3, 0, 2, 2]


def test_ema_of_a_tiny_rate_is_the_running_mean(spark):
    df = series(spark, [1, 2, 6])
    assert column(op.ema(df, "x", 1e-17, ONE, out="out")) == [1, 1.5, 3]
    assert column(op.ema(df, "x", 1e-17, ONE, adjust=False, out="out")) == [1, 1, 1]


def test_compat_covariance(spark):
    def of(x, y, ddof=1):
        return series(spark, x, y=y).agg(fn.nancovar("x", "y", ddof, compat=True).alias("c"), fn.nancovar("x", "y", ddof).alias("exact")).first()

    assert abs(of([1, 2, NAN, 4, 5], [2, 4, 6, NAN, 10]).c - 8.625) < 1e-9
    assert abs(of([1, NAN, 3, 4], [2, 4, 6, None]).c - 4.0) < 1e-9
    assert abs(of([5, 6, NAN, 8], [10, None, 14, 16]).c - 9.1111) < 1e-4
    assert abs(of([1, NAN, 3, 4], [2, 4, None, 8], 0).c - 4.5) < 1e-9
    assert of([1, 2, NAN], [2, None, 6]).c is None
    same = of([1, 2, 4], [3, 1, 9])
    assert abs(same.c - same.exact) < 1e-12


def test_skipna_of_a_function_on_values(spark):
    import numpy as np

    df = spark.createDataFrame([(None, 0, 3.0), (None, 1, NAN), (None, 2, 4.0), ("a", 0, None), ("a", 1, 5.0)], "k string, _x0 int, x double")
    made = op.skipna_values(df, np.cumsum, "x", series=Series(["k"], ["_x0"]), out="out")
    assert {(r.k, r._x0): r.out for r in made.collect()} == {(None, 0): 3.0, (None, 1): None, (None, 2): 7.0, ("a", 0): None, ("a", 1): 5.0}
