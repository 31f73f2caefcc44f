"""Near duplicates of embeddings by sorted projection passes.

Each pass names a vector by the concatenated signs of random projections, sorts
vectors lexicographically by that name and compares each with the bounded
window of its neighbours.  Close vectors agree in most signs, so they stand side
by side in some pass; the verified pairs of all passes are united to components.
Where many vectors crowd together a window holds few of a vector's links, so
passes go on until a round of them joins no two components any more.

A window holds few of the links of a large cluster.  So links are counted
within each component afterwards, exactly: its vectors are cut into blocks, and
each pair of blocks is multiplied in a task that gives counts, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved
from .components import connected_components

LEAST_COSINE = 0.98
#: Rows of a block that are multiplied at a time.
STRIPE = 256


def _directions(dimension: int, pass_no: int, bits: int) -> np.ndarray:
    return np.random.default_rng([41, pass_no, dimension]).normal(size=(dimension, bits))


def _units(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the vectors of a column, and for each length its rows and their unit vectors as a matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = np.cumsum(sizes)
    made = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
        made[size] = rows, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return sizes, made


def _keyed(usable: DataFrame, passes: range) -> DataFrame:
    """``pass, label, size, key, vec_id, vector`` for each pass; vectors keep the type of the input's numbers."""

    def run(batches):
        for batch in batches:
            sizes, units = _units(batch.column("vector"))
            order = np.concatenate([rows for rows, _ in units.values()])
            at = pa.array(order)
            vectors = batch.column("vector").take(at)
            for pass_no in passes:
                signs = [matrix @ _directions(size, pass_no, 63) > 0 for size, (_, matrix) in units.items()]
                keys = np.concatenate([(s.astype(np.uint64) << np.arange(62, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64) for s in signs])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), pass_no), pa.int32()), batch.column("label").take(at), pa.array(sizes[order], pa.int32()), pa.array(keys.view(np.int64)), batch.column("vec_id").take(at), vectors],
                    names=["pass", "label", "size", "key", "vec_id", "vector"],
                )

    label, vector = (usable.schema[c].dataType.simpleString() for c in ("label", "vector"))
    return usable.mapInArrow(run, f"pass int, label {label}, size int, key bigint, vec_id bigint, vector {vector}")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the pairs (u, v): each node but the smallest of its component with that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if np.array_equal(now, least):
            break
        least = now
    rest = least != np.arange(len(nodes))
    return nodes[least[rest]], nodes[rest]


def _window_pairs(groups: list[tuple], ids: np.ndarray, units: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sorted rows of one length that are at most a window apart, as stars."""
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault(g, len(names)) for g in groups], np.int64)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(window, len(ids) - 1) + 1):
        near = (group[step:] == group[:-step]) & (np.einsum("ij,ij->i", units[step:], units[:-step]) >= LEAST_COSINE)
        us.append(ids[:-step][near])
        vs.append(ids[step:][near])
    return stars(np.concatenate(us), np.concatenate(vs))


def _links(table: pa.Table, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between sorted rows, length by length."""
    groups = list(zip(*(table.column(c).to_pylist() for c in ("pass", "label", "size")), strict=True))
    ids = table.column("vec_id").to_numpy()
    out = []
    for size, (rows, units) in _units(table.column("vector").combine_chunks())[1].items():
        if size:
            out.append(_window_pairs([groups[r] for r in rows.tolist()], ids[rows], units, window))
    return out


def _neighbours(keyed: DataFrame, window: int) -> DataFrame:
    """Verified links (u, v) of each pass, saved.

    Rows are sorted over all tasks, by ranges; a task holds a batch and one
    window.  The first and the last rows of a range, a window of each, meet those
    of the ranges beside it in a second step, so that no border parts neighbours.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "size", "key", "vec_id"]

    def run(batches):
        here = TaskContext.get().partitionId()

        def sent(links, border, rows):
            u, v = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in (0, 1))
            columns = {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "border": pa.nulls(len(u), pa.int32())}
            edge = {"u": pa.nulls(rows.num_rows, pa.int64()), "v": pa.nulls(rows.num_rows, pa.int64()), "border": pa.array(np.full(rows.num_rows, border), pa.int32())}
            found = pa.table(columns | {f.name: pa.nulls(len(u), f.type) for f in rows.schema})
            return pa.concat_tables([found, pa.table(edge | {name: rows.column(name) for name in rows.schema.names})]).combine_chunks().to_batches()

        before = None
        seen = 0
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                now = rows if before is None else pa.concat_tables([before, rows])
                yield from sent(_links(now, window), here - 1, rows.slice(0, max(0, window - seen)))
                seen += batch.num_rows
                before = now.slice(max(0, now.num_rows - window))
        if before is not None:
            yield from sent([], here, before)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = saved(dealt.mapInArrow(run, f"u bigint, v bigint, border int, {kinds}"))

    def across(table):
        links = _links(table.sort_by([(c, "ascending") for c in order]), window)
        u, v = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    bordering = made.where("border is not null").groupBy("border").applyInArrow(across, "u bigint, v bigint")
    links = saved(made.where("border is null").select("u", "v").union(bordering).distinct())
    discard(made)
    return links


def _link_counts(members: DataFrame, block_rows: int) -> DataFrame:
    """``rep, others``: how many other vectors of its component each is linked with, copies counted.

    A vector goes to each pair of blocks that its own is one of, so a group
    holds two blocks, whatever the component's size.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "vector")

    def count(keys, table):
        i, j = keys[1].as_py(), keys[2].as_py()
        block, reps, copies = (table.column(c).to_numpy() for c in ("block", "rep", "copies"))
        ((_, units),) = _units(table.column("vector").combine_chunks())[1].values()  # a component has one length
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        to_left, to_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for at in range(0, len(left), STRIPE):
            stripe = left[at : at + STRIPE]
            near = units[stripe] @ units[right].T >= LEAST_COSINE
            if i == j:
                near[np.arange(len(stripe)), np.arange(at, at + len(stripe))] = False
            to_left[at : at + STRIPE] = near @ copies[right]
            to_right += near.T @ copies[stripe]
        made = [(reps[left], to_left)] if i == j else [(reps[left], to_left), (reps[right], to_right)]
        return pa.table({"rep": pa.array(np.concatenate([r for r, _ in made]), pa.int64()), "others": pa.array(np.concatenate([n for _, n in made]), pa.int64())})

    return dealt.groupBy("component", "i", "j").applyInArrow(count, "rep bigint, others bigint").groupBy("rep").agg(F.sum("others").alias("others"))


def joined_by_passes(vectors: DataFrame, passes: int, window: int) -> DataFrame:
    """``node, component`` of ``label, vec_id, vector``: first ``passes`` passes, then half as many at a time.

    A label takes part until a round joins no two of its components.
    """
    links = _neighbours(_keyed(vectors, range(passes)), window)
    joined = connected_components(links)
    discard(links)
    done, more = passes, max(1, passes // 2)
    active, labels = vectors, None
    while True:
        links = _neighbours(_keyed(active, range(done, done + more)), window)
        done += more
        of = {c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")) for c in ("u", "v")}
        placed = links.join(of["u"], "u", "left").join(of["v"], "v", "left")
        placed = placed.select(F.coalesce("u_component", "u").alias("u"), F.coalesce("v_component", "v").alias("v"))
        crossing = saved(placed.where("u <> v").distinct())
        discard(links)
        if labels is not None:
            discard(labels)
        if crossing.isEmpty():
            discard(crossing)
            return joined
        # A component's name is a vector of it, so it has the label.
        labels = saved(crossing.select(F.col("u").alias("vec_id")).join(vectors.select("vec_id", "label"), "vec_id").select("label").distinct())
        active = vectors.join(labels, "label", "left_semi")
        known = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
        now = connected_components(known.union(crossing))
        discard(crossing)
        discard(joined)
        joined = now


def near_vectors(vectors: DataFrame, *, passes: int = 16, window: int = 32, block_rows: int = 2048) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vec_id, embedding, label``.

    Vectors of one label (and one length) are linked when their cosine in double
    precision is at least 0.98.  Equal vectors are found by grouping, and one
    stands for them in the passes; n_links counts all of them.  No pair below
    0.98 is linked.  Components are those of the pairs that come within the
    window in a pass; n_links counts all links within the component.  After the
    first ``passes`` passes, rounds of half as many go on, for each label until one
    joins no two of its components.  A vector that is null, zero or holds a null or a non-finite
    component, or whose label or vec_id is null, is linked with nothing: it is
    its own component (null without vec_id).  Repeated rows of a vec_id are one
    vector and come back each; an empty table gives no rows; other columns are
    not read.

    block_rows: two blocks of about so many vectors of a component are counted
    against each other in a task.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # floats are compared in double precision, but travel as they are
    values = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", values.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    # -0.0 + 0.0 is 0.0, so equal vectors group together.
    classes = saved(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.countDistinct("vec_id").alias("copies")))
    joined = joined_by_passes(classes.select("label", "vec_id", "vector"), passes, window).select(F.col("node").alias("rep"), "component")
    members = classes.select(F.col("vec_id").alias("rep"), "copies", "vector").join(joined, "rep")
    degree = _link_counts(members, block_rows)
    reps = classes.select("label", "vector", F.col("vec_id").alias("rep"), "copies").join(degree, "rep", "left").join(joined, "rep", "left")
    named = reps.select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = usable.join(named, ["label", "vector"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(members, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
