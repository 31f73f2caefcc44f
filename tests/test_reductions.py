import numpy as np
import pytest
from helpers import INF, NAN, ONE, same, series

from tidemark import functions as fn
from tidemark import operators as op
from tidemark.series import Series

_ = None


def aggregated(df, *columns):
    return [tuple(r)[1:] for r in df.groupBy("k").agg(*(c.alias(f"c{i}") for i, c in enumerate(columns))).orderBy("k").collect()]


def test_sums_and_variances(spark):
    rows = aggregated(series(spark, [0, -1, 1.5, NAN], [NAN] * 4, [0, -1, 2, -2]), fn.nansum("x"), fn.nanmean("x"))
    assert same([r[0] for r in rows], [0.5, _, -1])
    (row,) = aggregated(series(spark, [1, 2, NAN, 4, 5]), fn.nanvar("x"), fn.nanvar("x", unbiased=False))
    assert same(list(row), [10 / 3, 2.5])
    (row,) = aggregated(series(spark, [3, NAN]), fn.nanvar("x"), fn.nanvar("x", unbiased=False))
    assert same(list(row), [_, 0])


def _textbook(x):
    """Sample skewness g1 and excess kurtosis g2 from central moments, and their usual corrections G1 and G2."""
    x = np.array(x, float)
    n, mean = len(x), np.mean(x)
    second, third, fourth = (np.mean((x - mean) ** power) for power in (2, 3, 4))
    g1, g2 = third / second**1.5, fourth / second**2 - 3
    big_g1 = g1 * np.sqrt(n * (n - 1)) / (n - 2)
    big_g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return [big_g1, big_g2, g1, g2]


def test_skewness_and_kurtosis(spark):
    x = [1.0, 2.5, -3, 4, 10, 0.5, 7]
    (row,) = aggregated(series(spark, [*x, NAN]), fn.nanskew("x"), fn.nankurtosis("x"), fn.nanskew("x", unbiased=False), fn.nankurtosis("x", unbiased=False))
    assert same(list(row), _textbook(x))
    rows = aggregated(series(spark, [1, 2, NAN, NAN], [1, 2, 3, NAN]), fn.nanskew("x", unbiased=False), fn.nankurtosis("x", unbiased=False), fn.nanskew("x"), fn.nankurtosis("x"))
    assert same([r[1] for r in rows], [-2, -1.5]) and same([r[0] for r in rows], [0, 0])
    assert same([r[2] for r in rows], [_, 0]) and same([r[3] for r in rows], [_, _])


def test_nanmax_and_nanmin(spark):
    cases = [[1, 0, 1], [INF, NAN, 1], [NAN, NAN, NAN], [-INF, NAN, NAN], [NAN, -INF, NAN], [NAN, 1, INF], [NAN, 1, 2]]
    rows = aggregated(series(spark, *cases), *fn.nanmax("x", "pos").values(), *fn.nanmin("x", "pos").values())
    assert same([r[0] for r in rows], [1, INF, _, -INF, -INF, INF, 2]) and [r[1] for r in rows] == [0, 0, 0, 0, 1, 2, 2]
    assert same([r[2] for r in rows], [0, 1, _, -INF, -INF, 1, 1]) and [r[3] for r in rows] == [1, 2, 0, 0, 1, 1, 1]


def test_pairs(spark):
    df = series(spark, [1, 2, NAN, 4, 5], y=[2, 4, 6, NAN, 10])
    (row,) = aggregated(df, fn.nancovar("x", "y"), fn.covar("x", "y"), fn.nanslope("x", "y"), fn.slope("x", "y"), fn.nancorrel("x", "y"), fn.correl("x", "y"))
    assert same(list(row), [26 / 3, _, 2, _, 1, _])
    (row,) = aggregated(df, fn.nanmulsum("x", "y"), fn.nanmulmean("x", "y"), fn.mulsum("x", "y"), fn.mulmean("x", "y"), fn.rms("x"))
    assert same(list(row), [60, 20, _, _, _])
    (row,) = aggregated(series(spark, [1, 2, 3], y=[2, 4, 7]), fn.mulsum("x", "y"), fn.mulmean("x", "y", ddof=1), fn.covar("x", "y"), fn.covar("x", "y", ddof=0), fn.rms("x"))
    assert same(list(row), [31, 15.5, 2.5, 5 / 3, np.sqrt(14 / 3)])


def test_constant_columns_have_no_correlation(spark):
    (row,) = aggregated(series(spark, [2, 2, 2], y=[1, 3, 5]), fn.correl("x", "y"), fn.nancorrel("x", "y"), fn.slope("x", "y"), fn.nanslope("x", "y"))
    assert list(row) == [None] * 4
    (row,) = aggregated(series(spark, [2, NAN], y=[1, 3]), fn.nancorrel("x", "y"), fn.nancovar("x", "y"), fn.nanslope("x", "y"))
    assert list(row) == [None] * 3


def test_bincount(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 3), (1, 3), (1, 1)], "k int, x int")
    made = [tuple(r) for r in op.bincount(df, "x", keys=["k"]).orderBy("k", "x").collect()]
    assert [n for _k, _x, n in made] == [0, 1, 2, 0, 0, 1, 0, 2]
    assert op.bincount(df, "x", keys=["k"], minlength=6).count() == 12
    assert op.bincount(df.where("false"), "x", keys=["k"]).count() == 0


def test_groupby(spark):
    ids = [0, 1, 3, 2, 1, 0, 3, 1, 2]
    df = spark.createDataFrame([(p, g, float(10 * p)) for p, g in enumerate(ids)], "pos int, g int, x double")
    made = {r.g: r["values"] for r in op.padded_groups(df, "x", "g", Series([], ["pos"])).collect()}
    assert made == {0: [0, 50, _], 1: [10, 40, 70], 2: [30, 80, _], 3: [20, 60, _]}
    slots = [r.slot for r in op.group_rows(df, "g", Series([], ["pos"])).orderBy("pos").collect()]
    assert slots == [0, 0, 0, 0, 1, 1, 1, 2, 1]


def test_stable_sort(spark):
    made = op.stable_sort(series(spark, [3, NAN, INF, 1, -INF, NAN, 2]), "x", "pos", ONE).orderBy("place").collect()
    assert [r["values"] for r in made] == [-INF, 1, 2, 3, INF, None, None]
    assert [r.indices for r in made] == [4, 3, 6, 0, 2, 1, 5]


def test_reduce_nan_patterns(spark):
    rows = [(0, 0, 1.0), (0, 1, NAN), (1, 0, NAN), (1, 1, NAN), (2, 0, 1.0), (2, 1, 2.0)]
    df = spark.createDataFrame([(p, r, 0, x) for p, r, x in rows], "pos int, ref int, other int, x double")
    got = {r.pos: r.mask for r in op.reduce_nan_patterns(df, "x", position="pos", ref="ref").collect()}
    assert got == {0: False, 1: False, 2: True}
    more = df.union(spark.createDataFrame([(2, 0, 1, NAN)], df.schema))
    assert {r.pos: r.mask for r in op.reduce_nan_patterns(more, "x", position="pos", ref="ref", all_others=True).collect()}[2] is False


def test_soft_ranking(spark):
    df = series(spark, [1, 2, 3, 4, 5])
    made = [r.out for r in op.soft_topk_bottomk(df, "x", 1, ONE, out="out").orderBy("pos").collect()]
    assert same(made, [-0.7624, -0.2123, 0, 0.2123, 0.7624], 1e-3)
    sharp = [r.out for r in op.soft_topk_bottomk(df, "x", 1, ONE, epsilon=1e-3, out="out").orderBy("pos").collect()]
    assert same(sharp, [-0.9965, -0.0035, 0, 0.0035, 0.9965], 1e-3)
    top = [r.out for r in op.soft_topk(df, "x", 2, ONE, out="out").collect()]
    assert abs(sum(top) - 2) < 1e-3 and min(top) >= 0


@pytest.mark.parametrize("scores, k, epsilon, error", [([1, 2], 2, 0.1, AssertionError), ([1, 2, 3], 1, 0, AssertionError), ([1, NAN, 2], 1, 0.1, ValueError)])
def test_soft_ranking_errors(scores, k, epsilon, error):
    from tidemark.operators.soft_topk import soft_scores

    with pytest.raises(error):
        soft_scores(np.array(scores, float), k, bottom=True, epsilon=epsilon, max_iter=10)
