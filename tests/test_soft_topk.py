import numpy as np
import pytest
from helpers import ONE, same, series
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.operators.soft_topk import soft_scores
from tidemark.series import Series


@pytest.mark.parametrize("bottom, epsilon, rows_per_part", [(False, 0.1, 1_000_000), (True, 1e-3, 1_000_000), (True, 0.1, 20), (False, 1e-3, 20)])
def test_groups_of_a_table_equal_single_lists(spark, bottom, epsilon, rows_per_part):
    rng = np.random.default_rng(4)
    groups = [rng.normal(size=60).round(1), rng.normal(size=7) * 1e9 + 1e12, np.full(5, 3.0), np.arange(1, 6.0)]
    rounds = (6 if epsilon < 0.01 else 10) if rows_per_part == 20 else 200
    df = series(spark, *[list(g) for g in groups])
    f = op.soft_topk_bottomk if bottom else op.soft_topk
    made = f(df, "x", 2, ONE, epsilon=epsilon, max_iter=rounds, out="out", rows_per_part=rows_per_part)
    assert made.columns == ["k", "pos", "x", "out"]
    got = [r.out for r in made.orderBy("k", "pos").collect()]
    want = [x for g in groups for x in soft_scores(g, 2, bottom=bottom, epsilon=epsilon, max_iter=rounds)]
    assert same(got, want, 1e-7)


def test_missing_scores_null_keys_and_all_of_a_group(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (None, 2, 5.0), ("a", 0, 2.0), ("a", 1, float("nan")), ("a", 2, 3.0)], "_n string, _score int, x double")
    got = {(r._n, r._score): r.out for r in op.soft_topk(df, "x", 1, Series(["_n"], ["_score"]), out="out").collect()}
    want = soft_scores(np.array([1.0, 5.0]), 1, bottom=False, epsilon=0.1, max_iter=200)
    assert got[None, 1] is None and got["a", 1] is None and same([got[None, 0], got[None, 2]], list(want), 1e-7)
    whole = [r.out for r in op.soft_topk(df.where("_n is null"), "x", 2, Series([], ["_score"]), out="out").collect() if r.x is not None]
    assert same(whole, [1.0, 1.0], 1e-6)
    assert op.soft_topk(df.limit(0), "x", 1, Series(["_n"], ["_score"])).collect() == []


@pytest.mark.parametrize("rows, k, message", [([1.0, 2.0], 2, "at least 4"), ([1.0, float("inf"), 3.0], 1, "finite")])
def test_errors(spark, rows, k, message):
    with pytest.raises(Exception, match=message):
        op.soft_topk_bottomk(series(spark, rows), "x", k, ONE).collect()
    with pytest.raises(AssertionError):
        op.soft_topk(series(spark, rows), "x", 1, ONE, epsilon=0)


def test_a_large_group_is_in_many_parts(spark):
    n = 100_000
    df = spark.range(n, numPartitions=8).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.rand(3) + F.lit(0.0)).alias("x"))
    made = op.soft_topk(df, "x", 500, ONE, out="out", rows_per_part=20_000, max_iter=10)
    rows = made.orderBy("pos").collect()
    want = soft_scores(np.array([r.x for r in rows]), 500, bottom=False, epsilon=0.1, max_iter=10)
    assert same([r.out for r in rows], list(want), 1e-7)
