"""What the operators share: tables, materialised steps, filters of fixed size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import discard as discard
from ..steps import saved as saved
from ..steps import shared_dir as shared_dir
from .kernels import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, for work whose Python objects are much larger than the rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or a longer one that is no column of the tables (in any case of letters)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class BitFilter:
    """A Bloom filter of fixed size over one or two bigint columns, made by Spark.

    At most ``2**bits / 64`` words reach the driver, whatever the input.  It
    answers True for every value put in and for some others; a full filter lets
    all through, so it saves work but never decides a result.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def _slots(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
        value = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            value = mix(value + column.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [(mix(value + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 2)]

    @classmethod
    def of(cls, values: DataFrame, columns: list[str], bits: int | None = None) -> BitFilter:
        """Sized by the number of rows unless bits are given: 16 MB at most, beyond which more values pass."""
        if bits is None:
            bits = min(27, max(16, (8 * values.count() - 1).bit_length()))

        def run(batches):
            words = np.zeros(1 << (bits - 6), np.uint64)
            for batch in batches:
                for slot in cls._slots([c.to_numpy() for c in batch.columns], bits):
                    np.bitwise_or.at(words, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
            used = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], names=["word", "mask"])

        rows = values.select(*columns).na.drop().mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
        return cls(words.view(np.uint64), bits)

    def has(self, *columns: np.ndarray) -> np.ndarray:
        out = np.ones(len(columns[0]), bool)
        for slot in self._slots(list(columns), self.bits):
            out &= ((self.words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def fitting(cls, values: DataFrame, columns: list[str], count: int) -> BitFilter | None:
        """A filter that few other values pass, or None if it would take more than 16 MB."""
        bits = max(16, (8 * count - 1).bit_length())
        return cls.of(values, columns, bits) if bits <= 27 else None

    def pass_on(self, batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
        """The rows of the batches whose columns it lets through; the columns hold no nulls."""
        for batch in batches:
            yield batch.filter(pa.array(self.has(*(batch.column(c).to_numpy() for c in columns))))

    def picked(self, df: DataFrame, *columns: str) -> DataFrame:
        """The rows of df whose columns it lets through."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        return df.na.drop(subset=list(columns)).mapInArrow(lambda batches: shared.value.pass_on(batches, *columns), df.schema)
