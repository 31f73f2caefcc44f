"""Inputs of the queries, the same in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import Series
from ..sources import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: Series of the event table: one per user, in order of time.
USER = Series(["user_id"], ["ts", "event_id"])
NAN = float("nan")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with x: the value, missing (NaN) in every seventh event."""
    df = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_id", "event_type", "value"])
    return df.withColumn("x", F.when(F.col("event_id") % 7 == 0, F.lit(NAN)).otherwise(F.col("value")))


EVENTS = "e AS (SELECT user_id, ts, event_id, event_type, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with x and y: quantity and price, missing in some rows."""
    df = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_partkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount"])
    x = F.when(F.col("l_partkey") % 11 == 0, F.lit(NAN)).otherwise(F.col("l_quantity"))
    y = F.when(F.col("l_orderkey") % 13 == 0, F.lit(NAN)).otherwise(F.col("l_extendedprice"))
    return df.withColumns({"x": x, "y": y})


LINES = """l AS (SELECT l_suppkey, l_partkey, l_orderkey, l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS x,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS y FROM lineitem)"""


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Both engines sum in their own order; results are compared after rounding."""
    return F.round(x, digits) + F.lit(0.0)


def sql_rounded(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0)"
