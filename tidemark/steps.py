"""Steps of a job that are written to the folder that the cluster shares, and deleted after use."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, but on one machine only."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if not set_already:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_already = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", set_already)
    return set_already.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a step that a lost executor can't undo.

    Shuffle files behind the rows aren't needed then; Spark deletes them once
    the driver has collected the garbage that refers to them, so that is done here.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what saved() wrote; the rows must not be needed any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
