"""Leading principal components of wide vectors, without their covariance matrix.

A random block of a few more directions than asked for is multiplied with the
covariance, what is new in the product is multiplied again, and so on: the blocks
together span a subspace (of Krylov) in which the leading components soon lie.  A
task multiplies its rows with a block and adds up what each dimension gets, so a
round shuffles a row a dimension and task.  The subspace, dimensions by some
hundred directions, is the driver's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import helper_names
from .linalg import _signed

#: Directions more than components: they take up what converges slowly.
SPARE = 10
#: Numbers of the subspace that the driver and each task may hold.
HELD = 1 << 27


def _product(rows: DataFrame, vector: str, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum over rows of (row - mean) times ((row - mean) times basis), for bases of dimensions by directions."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))
    width = basis.shape[1]

    def run(batches):
        centre, directions = shared.value
        total = np.zeros_like(directions)
        seen = False
        for batch in batches:
            column = batch.column(vector)
            for start in range(0, len(column), 256):
                part = column.slice(start, 256)
                x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(part), -1) - centre
                total += x.T @ (x @ directions)
                seen = True
        if seen:
            at = np.arange(len(total))
            # All of a dimension's sums lie in one row.
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), lists], names=["at", "sums"])

    parts = rows.select(vector).mapInArrow(run, "at int, sums array<double>")
    added = parts.groupBy("at").agg(*(F.sum(F.get("sums", k)).alias(f"s{k}") for k in range(width))).orderBy("at").toArrow()
    shared.unpersist()
    return np.stack([added.column(f"s{k}").to_numpy() for k in range(width)], axis=1)


def pca_top(df: DataFrame, vector: str, components: int, *, rounds: int = 60, tolerance: float = 1e-13, seed: int = 7) -> DataFrame:
    """``k, explained_variance, component``: the first principal components of an array column, by falling variance.

    As the first rows of pca for one group, for vectors of very many dimensions:
    no matrix of dimensions by dimensions is made.  Rounds go on until no
    variance changes by more than ``tolerance`` of itself, at most ``rounds`` of
    them.  The sign is that of pca.  Rows of a null vector or with a missing or
    infinite number make all results NULL, as do fewer than two rows; vectors of
    different lengths are an error.  Rows are read once a round, so a table that
    takes work to make should be written before.
    """
    t = helper_names(df)
    kind = df.schema[vector].dataType.elementType.simpleString()
    rows = df.select(F.col(vector).cast("array<float>" if kind == "float" else "array<double>").alias(t("v")))
    sound = F.col(t("v")).isNotNull() & F.forall(t("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n, whole, least, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.bool_and(sound), F.lit(True)), F.min(F.size(t("v"))), F.max(F.size(t("v")))).first()
    fields = "k bigint, explained_variance double, component array<double>"
    if not n:
        return df.sparkSession.createDataFrame([], fields)
    if not whole or n < 2:
        return df.sparkSession.createDataFrame([(k, None, None) for k in range(components)], fields)
    if least != most:
        raise ValueError("vectors of different lengths")
    components = min(components, most)
    width = min(components + SPARE, most)
    if 8 * most * width > HELD:
        raise ValueError(f"{most} dimensions by {width} directions are too many to hold")
    # Means of all dimensions by one pass: sums of the rows with a basis of ones.
    cells = rows.select(F.posexplode(t("v")).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).orderBy("at").toArrow()
    mean = cells.column("m").to_numpy()
    fresh = np.linalg.qr(np.random.default_rng(seed).normal(size=(most, width)))[0]
    basis, times, before = np.zeros((most, 0)), np.zeros((most, 0)), None
    for _ in range(rounds):
        basis = np.hstack([basis, fresh])
        times = np.hstack([times, _product(rows, t("v"), mean, fresh) / (n - 1)])
        # Within the subspace the covariance is a small matrix, whose eigenvectors are the best guess so far.
        small = basis.T @ times
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        if before is not None and np.all(np.abs(values[:components] - before) <= tolerance * abs(values[0])):
            break
        before = values[:components]
        # What the covariance makes of the latest directions, less what the subspace has already; twice, for rounding.
        fresh = times[:, -fresh.shape[1] :]
        size = np.linalg.norm(fresh)
        for _again in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        left, kept, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = left[:, kept > 1e-12 * max(size, 1e-300)][:, : most - basis.shape[1]]
        if not fresh.shape[1]:
            break
        if (basis.shape[1] + 2 * width) * most * 2 > HELD:  # begin again with the best directions
            basis, times, turned = basis @ turned[:, :width], times @ turned[:, :width], np.eye(width)
    found = basis @ turned
    vectors = _signed(found[:, :components].T)
    return df.sparkSession.createDataFrame([(k, float(v), c.tolist()) for k, (v, c) in enumerate(zip(values, vectors, strict=False))], fields)
