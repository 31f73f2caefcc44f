"""Rows of one long series in order, over many tasks.

A sample's order statistics cut the rows into ranges of about equal size; a
row's place is the number of rows in earlier ranges and its place within its own.
The cuts take the whole order, ties and all, so one value that fills half of the
series is cut as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import helper_names, join_keys

#: Sampled rows of each range.
SAMPLED = 64


def _cuts(df: DataFrame, key: str, ranges: int, t: Callable[[str], str]) -> DataFrame:
    """One row: the cuts in order, in chunks of some square root of their number, and each chunk's first."""
    chunk = max(1, round(ranges**0.5))
    # The rows of least hash are a sample of fixed size, the same for any partitioning.
    sample = df.select(key).orderBy(F.xxhash64(key)).limit(SAMPLED * ranges)
    ordered = sample.agg(F.array_sort(F.collect_list(key)).alias(t("sample")))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda i: F.get(t("sample"), (i * F.size(t("sample")) / ranges).cast("int")))
    cuts = ordered.select(F.array_distinct(F.filter(at, lambda c: c.isNotNull())).alias(t("cuts")))
    chunks = F.transform(F.filter(F.sequence(F.lit(0), F.lit(ranges), F.lit(chunk)), lambda i: i < F.size(t("cuts"))), lambda i: F.slice(t("cuts"), i + 1, chunk))
    made = cuts.select(chunks.alias(t("chunks")))
    return made.select(t("chunks"), F.transform(t("chunks"), lambda c: c[0]).alias(t("firsts")))


def with_places(df: DataFrame, keys: list[str], order: list[Column], *, ranges: int | None = None, out: str = "_row") -> DataFrame:
    """Adds the row's place within its key from 0, by the order columns, which must be total within the key.

    ranges: how many there are over all keys, the shuffle partitions if not
    given.  A task sorts a range of a key.  Nulls come first, in order columns and
    keys alike; a null key is a key like others.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = helper_names(df)
    key = F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], *[o.alias(f"o{n}") for n, o in enumerate(order)])
    keyed = df.withColumn(t("key"), key)
    # A cut of bounded size for each range.
    near = keyed.crossJoin(F.broadcast(_cuts(keyed, t("key"), ranges, t)))
    chunk = max(1, round(ranges**0.5))
    before = F.size(F.filter(t("firsts"), lambda c: c <= F.col(t("key")))) - 1
    within = F.size(F.filter(F.get(t("chunks"), F.col(t("chunk"))), lambda c: c <= F.col(t("key"))))
    ranged = near.withColumn(t("chunk"), before).withColumn(t("range"), F.when(F.col(t("chunk")) < 0, 0).otherwise(F.col(t("chunk")) * chunk + within))
    ranged = ranged.drop(t("chunk"), t("chunks"), t("firsts"))
    counts = ranged.groupBy(*keys, t("range")).agg(F.count(F.lit(1)).alias(t("n")))
    earlier = Window.partitionBy(*keys).orderBy(t("range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, t("range"), F.coalesce(F.sum(t("n")).over(earlier), F.lit(0)).alias(t("start")))
    place = F.row_number().over(Window.partitionBy(*keys, t("range")).orderBy(t("key"))) - 1
    numbered = ranged.withColumn(t("place"), place)
    return join_keys(numbered, starts, [*keys, t("range")]).withColumn(out, (F.col(t("start")) + F.col(t("place"))).cast("bigint")).select(*(c for c in df.columns if c != out), out)
