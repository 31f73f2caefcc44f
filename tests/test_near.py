import math
import time

import numpy as np
import pytest
from helpers import INF, NAN, ONE, column, same, series
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import operators as op
from tidemark.operators.blur import gaussian_weights
from tidemark.operators.near import blurred, rank_sums
from tidemark.series import Series


@pytest.mark.parametrize("period", [2, 5, 33, 500])
def test_rank_sums(period):
    rng = np.random.default_rng(period)
    x = rng.integers(0, 40, size=700).astype(float)
    got = rank_sums(x, period)
    for now in (period - 2, period - 1, period, 450, 699):
        if now < period - 1:
            assert got[now] == -1
        elif now < len(x):
            ages = np.arange(period)
            window = x[now - period + 1 : now + 1][::-1]
            rank = np.array([((window > v) | ((window == v) & (ages < a))).sum() for a, v in enumerate(window)])
            assert got[now] == (ages * rank).sum()


def test_rank_sums_hardly_depend_on_the_period():
    x = np.random.default_rng(1).normal(size=40_000)
    took = {}
    for period in (5, 500):
        began = time.perf_counter()
        rank_sums(x, period)
        took[period] = time.perf_counter() - began
    assert took[500] < 4 * took[5]


def test_rci_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = [NAN if rng.random() < 0.03 else float(rng.integers(0, 9)) for _ in range(300)]
    df = series(spark, x, [1.0, 2.0, INF, -INF, 5.0]).withColumn("k", F.nullif("k", F.lit(1)))
    want = column(df.withColumn("out", fn.rci("x", ONE, 6)))
    assert same(column(op.wide_rci(df, "x", ONE, 6, out="out")), want)
    assert same(column(op.wide_rci(df, "x", ONE, 6, rows_per_block=4, out="out")), want)
    blocked = op.with_blocks(df, "pos", ["k"], rows_per_block=16, slice_width=99)
    assert same(column(op.wide_rci(blocked, "x", Series(["k"], ["_row"]), 6, row="_row", rows_per_block=50, out="out")), want)
    assert op.wide_rci(df.limit(0), "x", ONE, 6).collect() == []


def direct(x, weights):
    reach, out = len(weights) // 2, []
    for i in range(len(x)):
        near = [(x[j], weights[j - i + reach]) for j in range(max(0, i - reach), min(len(x), i + reach + 1)) if not math.isnan(x[j])]
        low = sum(w for _, w in near)
        out.append(sum(v * w for v, w in near) / low if low > 0 else math.nan)
    return np.array(out)


@pytest.mark.parametrize("sigma", [0.3, 1.5, 20.0])
def test_blur_against_the_sum(sigma):
    rng = np.random.default_rng(2)
    weights = np.array(gaussian_weights(sigma, math.ceil(9 * sigma)))
    x = rng.normal(size=900)
    x[rng.random(900) < 0.2] = NAN
    x[300:420] = NAN
    for values in (x, x * 1e9, np.where(np.arange(900) == 100, 1e14, x), np.full(50, NAN)):
        assert np.allclose(blurred(values, weights), direct(values, weights), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_blur_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = [NAN if rng.random() < 0.1 else float(rng.random()) for _ in range(200)]
    df = series(spark, x, [1.0, NAN, INF])
    want = column(op.gaussian_blur(df, "x", 1.5, ONE, out="out"))
    assert same(column(op.wide_gaussian_blur(df, "x", 1.5, ONE, out="out"))[:200], want[:200], 1e-9)
    assert same(column(op.wide_gaussian_blur(df, "x", 1.5, ONE, rows_per_block=9, out="out"))[:200], want[:200], 1e-9)
    golden = [0.0864, 0.6494, 2.4324, 3.8310, 2.4324, 0.6494, 0.0864]
    assert same(column(op.wide_gaussian_blur(series(spark, [0, 0, 0, 10, 0, 0, 0]), "x", 1.0, ONE, out="out")), golden, 1e-3)
