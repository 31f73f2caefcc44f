"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the folder; the columns named are all that is scanned."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, folder: str, name: str, *, partition_by: list[str] | None = None) -> None:
    """Writes (over) a table of the folder."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{folder}/{name}.parquet")
