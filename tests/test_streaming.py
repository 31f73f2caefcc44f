import datetime

import pandas as pd
import pytest

from tidemark.streaming import running_ema, running_sum

pytestmark = pytest.mark.filterwarnings("ignore")


def day(n):
    return datetime.datetime(2024, 1, n)


def run(spark, tmp_path, make):
    """Two files, one micro-batch each; the second holds a row that comes too late."""
    schema = "user bigint, ts timestamp, id bigint, x double"
    first = [(1, day(1), 1, 1.0), (1, day(2), 2, 2.0), (2, day(1), 3, 5.0)]
    second = [(1, day(3), 4, 3.0), (1, day(1), 0, 9.0), (2, day(2), 5, None), (2, day(3), 6, 7.0)]
    source = tmp_path / "in"
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return {(r.user, r.id): r[-1] for r in spark.table("made").collect()}


def test_ema(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: running_ema(s, "user", "ts", "id", "x", 0.5))
    assert (1, 0) not in got
    assert got[1, 4] == pytest.approx(pd.Series([1.0, 2, 3]).ewm(alpha=0.5).mean().iloc[-1])
    assert got[2, 3] == 5 and got[2, 5] is None and got[2, 6] is None


def test_sum(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: running_sum(s, "user", "ts", "id", "x"))
    assert (got[1, 4], got[2, 5], got[2, 6]) == (6, None, 12)
