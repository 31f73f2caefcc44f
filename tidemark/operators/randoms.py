"""Tables of random numbers: the same for any partitioning, given the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hashed_half, permuting_plan, rand, randint, randn
from ..series import helper_names


def rand_table(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``id, value``: n uniform numbers in [0, 1)."""
    return spark.range(n).withColumn("value", rand("id", seed=seed))


def randn_table(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``id, value``: n standard normal numbers."""
    return spark.range(n).withColumn("value", randn("id", seed=seed))


def randint_table(spark: SparkSession, low: int, high: int, n: int, seed: int = 42) -> DataFrame:
    """``id, value``: n whole numbers from low to high - 1."""
    return spark.range(n).withColumn("value", randint(low, high, "id", seed=seed))


def with_rand(df: DataFrame, *ids: str, seed: int = 42, out: str = "rand") -> DataFrame:
    """rand_like: adds a uniform column, a function of the rows' ids."""
    return df.withColumn(out, rand(*ids, seed=seed))


def with_randn(df: DataFrame, *ids: str, seed: int = 42, out: str = "randn") -> DataFrame:
    """randn_like: adds a standard normal column, a function of the rows' ids."""
    return df.withColumn(out, randn(*ids, seed=seed))


def with_permuted(df: DataFrame, id_col: str, n: int, seed: int = 42, *, out: str = "value") -> DataFrame:
    """Adds the id's place in a permutation of 0 to n - 1: a function of the id, n and seed alone.

    A network in the manner of Feistel over a grid of about the square root of n
    a side: each step shifts one coordinate by a hash of the other, which can be
    undone, so different ids get different places.  No sort, shuffle or join.
    NULL for an id that is NULL or not from 0 to n - 1.
    """
    t = helper_names(df)
    a, b, keys, again = permuting_plan(n, seed)
    number = F.col(id_col).cast("bigint")
    step = df.withColumn(t("y"), F.when((number >= 0) & (number < n), number))
    high, low = F.col(t("high")), F.col(t("low"))
    for k in range(1 + again):
        step = step.withColumns({t("high"): F.expr(f"`{t('y')}` div {b}"), t("low"): F.col(t("y")) % b})
        for j, key in enumerate(keys):
            if j % 2:
                step = step.withColumn(t("low"), (low + hashed_half(high, key)) % b)
            else:
                step = step.withColumn(t("high"), (high + hashed_half(low, key)) % a)
        made = high * b + low
        # From the second pass on only those move that lie beyond the ids.
        step = step.withColumn(t("y"), made if k == 0 else F.when(F.col(t("y")) < n, F.col(t("y"))).otherwise(made))
    return step.withColumn(out, F.col(t("y"))).select(*(c for c in df.columns if c != out), out)


def randperm(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``id, value``: a permutation of 0 to n - 1."""
    return with_permuted(spark.range(n), "id", n, seed)
