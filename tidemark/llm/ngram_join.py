"""Near duplicates by a set-similarity join of word n-grams with rare-first prefix filtering.

Documents with the same set of n-grams form a class and one stands for it.  The
n-grams of a set are put in one global order, rare ones first; two sets that are
similar enough share one of their first few.  Prefix n-grams are joined under
the length and the positional filter.  Surviving pairs are compared by the sizes
of their sets' parts, then loaded; the suffix filter halves what stands behind
the first shared n-gram again and again to see whether enough can be shared, and
what is left is verified once by the exact intersection.

Groups of many similar documents would make a pair of every two.  So pairs are
taken in rounds: first each document with one pivot of its prefix group; then,
after links have been contracted to components, each with a few of its group
that stand beside it in an order drawn anew, as long as that contracts more; at
last all pairs that still cross components.  A pair left out joins two documents
that are linked already, so components are those of all links.  Groups of two
have no pair behind the first round; they leave, as do groups whose sizes and
positions allow no pair without the pivot, and groups of one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BitFilter, discard, saved, slices, unused
from .components import connected_components
from .kernels import chunks, mix, shingle_sets, text_buffer

WORDS = 5
#: Two sets are linked when 100 times their intersection is at least 75 times their union.
PART, WHOLE = 75, 100
SKETCH_BITS = 22
SKETCH_PART = 1 << 14
#: Rows of an n-gram's group that meet the group in one task, at about this number.
GROUP_PART = 5_000
#: N-grams of a bucket of the sketch beyond which they are dealt by document too, at the least.
HOT_BUCKET = 250
#: Rows of an n-gram's group that a row meets on each side in a round of neighbours, and such rounds at most.
NEIGHBOURS, ROUNDS = 3, 8
#: Meetings that the last round may make for each posting without rounds of neighbours before it.
MEETINGS = 2
POSTING = "token bigint, salt int, salts int, doc_id bigint, n int, pos int"


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection that links sets of a and b n-grams."""
    return -(-PART * (a + b) // (PART + WHOLE))


def _least_overlap_column(a: Column, b: Column) -> Column:
    return F.ceil(F.lit(float(PART)) * (a + b) / float(PART + WHOLE) - 1e-9)


def prefix_length(n: int) -> int:
    """N-grams of which two linked sets, one of n, must share one."""
    return n - -(-PART * n // WHOLE) + 1 if n else 0


def signature(found: np.ndarray) -> bytes:
    """Sizes of a set's parts by the upper bits of the hash: half as many parts as values, or more."""
    bits = max(0, len(found).bit_length() - 1)
    sizes = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64), minlength=1 << bits)
    return sizes.astype(np.uint8).tobytes() if len(found) and sizes.max() < 256 else b""


def parts_allow(x: bytes, y: bytes, least: int) -> bool:
    """Whether sets with these signatures may share ``least`` values.

    What one part holds more than its counterpart can't be shared.  The finer
    signature is folded to the parts of the other; an empty one tells nothing.
    """
    if not x or not y:
        return True
    a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((x, y), key=len))
    b = b.reshape(len(a), -1).sum(1)
    return int(np.minimum(a, b).sum()) >= least


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def least_difference(x: np.ndarray, y: np.ndarray, most: int, depth: int = 4) -> int:
    """A lower bound of how many values only one of two sorted sets has; beyond ``most`` it isn't refined."""
    apart = abs(len(x) - len(y))
    if apart > most or depth == 0 or not len(x) or not len(y):
        return apart
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    found = int(at < len(x) and x[at] == y[middle])
    left = least_difference(x[:at], y[:middle], most, depth - 1)
    right = abs(len(x) - at - found - (len(y) - middle - 1))
    if left + right + 1 - found <= most:
        right = least_difference(x[at + found :], y[middle + 1 :], most - left, depth - 1)
    return left + right + 1 - found


def suffix_allows(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as places in the global order, can be linked by what follows their first shared value."""
    least = least_overlap(len(x), len(y))
    prefix = x[: prefix_length(len(x))]
    at = np.minimum(np.searchsorted(y, prefix), len(y) - 1)
    hits = np.flatnonzero(y[at] == prefix)
    if not len(hits):
        return False
    i = int(hits[0])
    rest_x, rest_y = x[i + 1 :], y[int(at[i]) + 1 :]
    most = len(rest_x) + len(rest_y) - 2 * (least - 1)
    return most >= 0 and least_difference(rest_x, rest_y, most) <= most


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test."""
    least = least_overlap(len(x), len(y))
    return min(len(x), len(y)) >= least and shared_count(x, y) >= least


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def _sets(batch: pa.RecordBatch):
    """Row number and set of each row."""
    data, offsets = text_buffer(batch.column("text"))
    for low, high in chunks(offsets):
        yield from enumerate(shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], WORDS), low)


def set_sizes(source: DataFrame) -> DataFrame:
    """``doc_id, n, name, data`` of each row: its set's size, 128-bit name and signature; and rows of the frequency sketch.

    The sketch counts n-grams over all documents in a fixed number of buckets
    by hash.  A task gives its counts in parts: ``n`` is a part's first bucket,
    ``data`` the counts from there on.
    """

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            n, names, signatures = [], [], []
            for _, found in _sets(batch):
                n.append(len(found))
                names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append(signature(found))
                np.add.at(sketch, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary()), pa.array([False] * len(n), pa.bool_())], names=["doc_id", "n", "name", "data", "sketch"])
        rows = [k for k in range(0, len(sketch), SKETCH_PART) if sketch[k : k + SKETCH_PART].any()]
        packed = [pa.compress(sketch[k : k + SKETCH_PART].astype("<u4").tobytes(), codec="zstd", asbytes=True) for k in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array(packed, pa.binary()), pa.array([True] * len(rows), pa.bool_())],
            names=["doc_id", "n", "name", "data", "sketch"],
        )

    return source.mapInArrow(run, "doc_id bigint, n bigint, name binary, data binary, sketch boolean")


def frequency_levels(sizes: DataFrame) -> np.ndarray:
    """The level of each bucket of the sketch: 256 times the logarithm of its count over all documents."""

    def add(batches):
        # Parts of one place follow each other: a task holds one sum, however many tasks have counted.
        place, total = None, np.zeros(SKETCH_PART, np.int64)

        def made():
            level = np.floor(256 * np.log2(total + 1.0)).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([level], pa.binary())], names=["n", "level"])

        for batch in batches:
            for at, part in zip(batch.column("n").to_pylist(), batch.column("data"), strict=True):
                if at != place:
                    if place is not None:
                        yield made()
                    place, total = at, np.zeros(SKETCH_PART, np.int64)
                total += np.frombuffer(pa.decompress(part.as_py(), 4 * SKETCH_PART, codec="zstd", asbytes=True), "<u4")
        if place is not None:
            yield made()

    levels = np.zeros(1 << SKETCH_BITS, np.uint16)
    dealt = sizes.where("sketch").select("n", "data").repartition(_parts(sizes), "n").sortWithinPartitions("n")
    for start, part in dealt.mapInArrow(add, "n bigint, level binary").collect():
        levels[start : start + SKETCH_PART] = np.frombuffer(part, "<u2")
    return levels


def places(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Where the values of a set stand in the global order: by the level of the bucket, then by the hash's upper 48 bits."""
    level = levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(48)) | (found >> np.uint64(16))


def rare_first(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the global order."""
    return found[np.argsort(places(found, levels), kind="stable")]


def hot_bucket(levels: np.ndarray, parts: int) -> float:
    """The count of a bucket of the sketch beyond which its n-grams are dealt by document too.

    A 64th of a task's share of all n-grams, about a sixteenth of its share of
    the prefixes; where tasks are very many, eight times a bucket's mean.
    """
    total = float((np.exp2(np.arange(1 << 16) / 256) - 1) @ np.bincount(levels, minlength=1 << 16))
    return max(HOT_BUCKET, total / (64 * parts), 8 * total / len(levels))


def salts_of(token: np.ndarray, levels: np.ndarray, most: float) -> np.ndarray:
    """How many tasks an n-gram's group is dealt to: 1 unless its bucket counts more than ``most``."""
    bucket = (token.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return np.ceil(np.exp2(levels[bucket] / 256) / most).clip(1, 1 << 30).astype(np.int32)


def _prefix_batches(batches: Iterable[pa.RecordBatch], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``doc_id, n, tokens`` of each row: its set's size and its prefix, packed."""
    for batch in batches:
        for rows in slices([batch], 1_000):
            n, tokens = [], []
            for _, found in _sets(rows):
                n.append(len(found))
                tokens.append(rare_first(found, levels)[: prefix_length(len(found))].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int32()), pa.array(tokens, pa.binary())], names=["doc_id", "n", "tokens"])


def _posting_batches(batches: Iterable[pa.RecordBatch], levels: np.ndarray, most: float) -> Iterator[pa.RecordBatch]:
    """``token, salt, salts, doc_id, n, pos``: a row for each n-gram of each prefix."""
    for batch in batches:
        lengths = pc.binary_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<i8")
        row = np.repeat(np.arange(batch.num_rows), lengths)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        index = pa.array(row)
        draw = (mix(batch.column("doc_id").to_numpy().view(np.uint64)) >> np.uint64(33)).astype(np.int64)
        for start in range(0, len(tokens), 100_000):
            part = slice(start, start + 100_000)
            salts = salts_of(tokens[part], levels, most)
            salt = (draw[row[part]] % salts).astype(np.int32)
            columns = [pa.array(tokens[part]), pa.array(salt), pa.array(salts), batch.column("doc_id").take(index[part]), batch.column("n").take(index[part]), pa.array(pos[part], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "salt", "salts", "doc_id", "n", "pos"])


def prefix_postings(source: DataFrame, levels: np.ndarray, reps: DataFrame, count: int) -> DataFrame:
    """``token, salt, salts, doc_id, n, pos``: the postings of the documents of ``reps`` (``doc_id, n``), whose rows ``count`` bounds.

    An n-gram that may be common, as its bucket of the sketch says, is dealt to
    ``salts`` tasks by document before anything is shuffled.

    A copy that stands for itself beside its class only repeats the class's
    links, so a filter will do to leave copies out, and texts become postings in
    one Python step; beyond the filter's bound, copies are left out by a join.
    """
    context = source.sparkSession.sparkContext
    shared, some = context.broadcast(levels), BitFilter.fitting(reps, ["doc_id"], count)
    most = hot_bucket(levels, _parts(source))
    if some is None:
        packed = source.mapInArrow(lambda batches: _prefix_batches(batches, shared.value), "doc_id bigint, n int, tokens binary")
        return packed.join(reps, ["doc_id", "n"], "left_semi").select("doc_id", "n", "tokens").mapInArrow(lambda batches: _posting_batches(batches, shared.value, most), POSTING)
    known = context.broadcast(some)
    return source.mapInArrow(lambda batches: _posting_batches(_prefix_batches(known.value.pass_on(batches, "doc_id"), shared.value), shared.value, most), POSTING)


def _possible(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Length filter, and positional filter as it holds at the first n-gram that two sets share.

    Nothing before it is shared, so what follows in both must make up the
    overlap.  A linked pair passes there; rows of its later n-grams may not.
    """
    overlap = F.least(n_a - pos_a, n_b - pos_b)
    return (WHOLE * F.least(n_a, n_b) >= PART * F.greatest(n_a, n_b)) & (overlap >= _least_overlap_column(n_a, n_b))


def grouped_postings(posted: DataFrame) -> DataFrame:
    """The postings of n-grams that several rows have, each with its group's pivot: the smallest doc_id.

    A group is a token's rows of one salt, read as a sorted stream, so that its
    size takes no memory; ``wide`` tells whether it has more than two rows.  Of
    salted tokens groups of one row are there too.
    """
    names = ["token", "salt", "salts", "doc_id", "n", "pos"]

    def made(rows, at, first, wide):
        columns = [column[at] for column in rows] + [column[first[at]] for column in rows[3:]] + [wide[at]]
        for low in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 100_000]) for c in columns], names=[*names, "pivot", "pivot_n", "pivot_pos", "wide"])

    def run(batches):
        # Of the last group so far: all of its rows while they are one or two, held back; else its pivot, and the rest was sent.
        carried, sent = None, False
        for batch in batches:
            rows = [batch.column(name).to_numpy() for name in names]
            if not batch.num_rows:
                continue
            if carried is not None:
                rows = [np.concatenate(pair) for pair in zip(carried, rows, strict=True)]
            token, salt, salts = rows[:3]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(token)))
            wide = sizes > 2
            wide[0] |= sent
            send = np.repeat((sizes > 1) | (salts[starts] > 1) | wide, sizes)
            if sent:
                send[0] = False
            last, sent = starts[-1], bool(wide[-1])
            if not sent:
                send[last:] = False
            carried = [column[last : last + 1 if sent else None].copy() for column in rows]
            yield from made(rows, np.flatnonzero(send), np.repeat(starts, sizes), np.repeat(wide, sizes))
        if carried is not None and not sent and (len(carried[0]) > 1 or carried[2][0] > 1):
            at = np.arange(len(carried[0]))
            yield from made(carried, at, np.zeros_like(at), np.zeros(len(at), bool))

    dealt = posted.repartition(_parts(posted), "token", "salt").sortWithinPartitions("token", "salt", "doc_id")
    return dealt.mapInArrow(run, f"{POSTING}, pivot bigint, pivot_n int, pivot_pos int, wide boolean")


def salted_postings(grouped: DataFrame) -> DataFrame:
    """The rows of salted tokens with the pivot of all of a token's groups; tokens of one row leave.

    Groups are summed up first: a token's groups meet, never its rows.
    """
    pivot = F.struct("pivot", "pivot_n", "pivot_pos")
    salted = grouped.where("salts > 1")
    groups = salted.groupBy("token", "salt").agg(F.count(F.lit(1)).alias("rows"), F.min(pivot).alias("least"))
    tokens = groups.groupBy("token").agg(F.sum("rows").alias("rows"), F.min("least").alias("least")).where("rows > 1").select("token", "least.*", (F.col("rows") > 2).alias("wide"))
    named = groups.select("token", "salt").join(tokens, "token")
    return salted.drop("pivot", "pivot_n", "pivot_pos", "wide").join(named, ["token", "salt"]).select(*grouped.columns)


def sets_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, n, tokens``: the packed sets of the wanted documents, each sorted."""
    some = BitFilter.of(wanted, ["doc_id"])
    shared = source.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        for batch in shared.value.pass_on(batches, "doc_id"):
            found = [x for _, x in _sets(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in found], pa.int32()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["doc_id", "n", "tokens"])

    rows = source.where("doc_id is not null").mapInArrow(run, "doc_id bigint, n int, tokens binary")
    return rows.join(wanted, "doc_id", "left_semi")


def with_pairs_left(groups: DataFrame) -> DataFrame:
    """The rows of unsalted groups that may hold a pair without the pivot; the pivot's pairs are tested by then.

    Of two rows the one of the smaller set (of equal ones, the later) is held
    against the next larger set of the group, as if all of that were still to
    come.  Where this allows no link, no pair that it would be the smaller of does.
    """
    others = ~((F.col("doc_id") == F.col("pivot")) & (F.col("n") == F.col("pivot_n")) & (F.col("pos") == F.col("pivot_pos")))
    larger = Window.partitionBy("token").orderBy(F.desc("n"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = groups.withColumns({"other": others, "nearest": F.min(F.when(others, F.col("n"))).over(larger)})
    may = F.col("other") & F.coalesce(_possible(F.col("n"), F.col("pos"), F.col("nearest"), F.lit(0)), F.lit(False))
    return rows.withColumn("left", F.max(may).over(Window.partitionBy("token"))).where("left").select(*groups.columns)


def _placed(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """The postings with the component that theirs, and that of their group's pivot, is in now."""
    of_row = joined.select(F.col("node").alias("component"), F.col("component").alias("found"))
    of_pivot = joined.select(F.col("node").alias("pivot_component"), F.col("component").alias("pivot_found"))
    placed = postings.join(of_row, "component", "left").join(of_pivot, "pivot_component", "left")
    return saved(placed.select("token", "salt", "salts", "doc_id", "n", "pos", F.coalesce("found", "component").alias("component"), F.coalesce("pivot_found", "pivot_component").alias("pivot_component")))


def _still_open(placed: DataFrame) -> DataFrame:
    """The postings of groups of more than one component; a group of one stays one, whatever links are found.

    A salted token's rows stay dealt: its salts are summed up first, and those meet.
    """
    groups = placed.groupBy("token", "salt").agg(F.max(F.col("component") != F.col("pivot_component")).alias("apart"))
    tokens = groups.groupBy("token").agg(F.max("apart").alias("apart")).where("apart").select("token")
    return placed.join(groups.select("token", "salt").join(tokens, "token"), ["token", "salt"], "left_semi")


def _band(n: Column) -> Column:
    """Bands of size; linked sets fall in one or in two beside each other."""
    return F.floor(F.log(n) / float(np.log(WHOLE / PART))).cast("int")


def _meetings(placed: DataFrame) -> int:
    """How many meetings within groups their components leave open, at most."""
    apart = F.count_if(F.col("component") != F.col("pivot_component"))
    groups = placed.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), apart.alias("apart"))
    return int(groups.agg(F.sum(F.col("rows").cast("double") * F.col("apart"))).first()[0] or 0)


def _neighbours(placed: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) across components that stand near each other in a group, ordered by band of size and then by chance.

    They grow with the postings, not with the square of a group; each round
    number draws another order and deals the rows of salted tokens anew.
    """
    drawn = F.xxhash64("doc_id", "token", F.lit(number))
    rows = placed.select("token", "doc_id", "n", "pos", "component", _band(F.col("n")).alias("band"), drawn.alias("drawn"), F.pmod(drawn, "salts").alias("deal"))
    order = Window.partitionBy("token", "deal").orderBy("band", "drawn", "doc_id")
    before = F.array(*(F.lag(F.struct("doc_id", "n", "pos", "component"), k).over(order) for k in range(1, NEIGHBOURS + 1)))
    met = rows.withColumn("before", before).select("doc_id", "n", "pos", "component", F.explode("before").alias("y")).where(F.col("y").isNotNull() & (F.col("component") != F.col("y.component")))
    met = met.where(_possible(F.col("n"), F.col("pos"), F.col("y.n"), F.col("y.pos")))
    return met.select(F.least("doc_id", "y.doc_id").alias("a"), F.greatest("doc_id", "y.doc_id").alias("b")).distinct()


def _crossing(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a group whose components differ, under both filters, each once."""
    # Groups of one component are done; elsewhere only what the pivot's component lacks meets the group.
    apart = placed.where("component <> pivot_component")
    # A large group is dealt by bands of size and by document.
    deals = apart.groupBy("token", "salts").agg(F.ceil(F.count(F.lit(1)) / GROUP_PART).cast("int").alias("deals"))
    salted = placed.where("salts > 1").select("token", "salt").distinct().join(deals.where("salts > 1"), "token")
    deals = deals.where("salts = 1").select("token", F.lit(0).alias("salt"), "deals").union(salted.select("token", "salt", "deals"))
    band = _band(F.col("n"))
    names = ("doc_id", "n", "pos", "component", "pivot_component")
    x = apart.join(deals, ["token", "salt"]).withColumns({"band": band, "deal": F.pmod(F.xxhash64("doc_id"), F.col("deals")).cast("int")})
    x = x.select("token", "band", "deal", *(F.col(c).alias(f"x_{c}") for c in names))
    y = placed.join(deals, ["token", "salt"]).withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    y = y.select("token", "band", "deal", *(F.col(c).alias(f"y_{c}") for c in names))
    possible = _possible(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"))
    # Two that are both apart would meet twice.
    once = (F.col("y_component") == F.col("y_pivot_component")) | (F.col("x_doc_id") < F.col("y_doc_id"))
    met = x.join(y, ["token", "band", "deal"]).where((F.col("x_component") != F.col("y_component")) & once & possible)
    return met.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def parts_filtered(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets' parts are of sizes that allow a link."""
    signatures = BitFilter.of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), ["doc_id"]).picked(signatures, "doc_id")
    left = signatures.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("data").alias("x"))
    right = signatures.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("data").alias("y"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "x", "y")]
            keep = [parts_allow(x, y, least_overlap(a, b)) for a, b, x, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, source: DataFrame, levels: np.ndarray) -> DataFrame:
    """Those of the pairs (a, b) that are linked, each tested once."""
    sets = saved(sets_of(source, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    shared = source.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            keep = []
            for pair in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = (np.frombuffer(packed, "<u8") for packed in pair)
                keep.append(suffix_allows(*(np.sort(places(s, shared.value)) for s in (x, y))) and linked(x, y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = saved(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
    discard(sets)
    return found


def near_duplicate_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row.

    A text's words are what stands between white space of ASCII, A-Z in lower
    case; its set holds its distinct runs of five words, or all its words as one
    if it has fewer.  Two documents are linked when 100 times the intersection
    of their sets is at least 75 times the union.  component_id is the smallest
    doc_id that links reach.  A null, empty or blank text has an empty set,
    linked with nothing; so has a row without doc_id (component_id null).  Rows
    that share a doc_id are one document where their texts are equal; with
    different texts, all of them are linked.  Repeated rows come back each; an
    empty table gives no rows; other columns are not read.  The result is a
    written table, which discard() deletes.
    """
    source = _source(docs, id_col, text_col)
    sizes = saved(set_sizes(source))
    levels = frequency_levels(sizes)
    rows = sizes.where("not sketch").select("doc_id", "n", "name", "data")
    classes = saved(rows.where("doc_id is not null and n > 0").groupBy("name").agg(F.min("doc_id").alias("rep"), F.min("n").cast("int").alias("n")))
    reps = classes.select(F.col("rep").alias("doc_id"), "n").distinct()
    grouped = saved(grouped_postings(prefix_postings(source.where("doc_id is not null"), levels, reps, classes.count())))
    salted = saved(salted_postings(grouped))
    shared = grouped.where("salts = 1").union(salted)
    # First round: each document with the pivot of each of its groups.
    possible = _possible(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"))
    signatures = rows.select("doc_id", "n", "data")
    pairs = saved(shared.where((F.col("doc_id") > F.col("pivot")) & possible).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    likely = saved(parts_filtered(pairs, signatures))
    links = verified(likely, source, levels)
    discard(likely)
    joined = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(links)

    def contracted(made: DataFrame) -> DataFrame:
        """The components once the links among these pairs are known too."""
        likely = saved(parts_filtered(made, signatures))
        links = verified(likely, source, levels)
        more = None if links.isEmpty() else connected_components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links.select("a", "b")))
        for done in (likely, links, *((joined,) if more is not None else ())):
            discard(done)
        return joined if more is None else more

    # Rounds of neighbours, while they halve what is left open.
    # A group of two has no pair but its pivot's, which is tested; others may have none that their sizes allow.
    wide = with_pairs_left(grouped.where("salts = 1 and wide")).union(salted.where("wide"))
    open_yet = wide.withColumns({"component": F.col("doc_id"), "pivot_component": F.col("pivot")})
    tested, placed = [pairs], _placed(open_yet, joined)
    most, still = MEETINGS * shared.count(), _meetings(placed)
    for number in range(ROUNDS):
        if still <= most:
            break
        made = saved(reduce(lambda left, known: left.join(known, ["a", "b"], "left_anti"), tested, _neighbours(placed, number)))
        tested.append(made)
        joined = contracted(made)
        before, last = placed, still
        placed = _placed(_still_open(before), joined)
        discard(before)
        still = _meetings(placed)
        if still > last / 2:
            break
    # Last round: all pairs of a group that cross components, at least one of them not in the pivot's.
    crossing = saved(reduce(lambda left, known: left.join(known, ["a", "b"], "left_anti"), tested, _crossing(placed)))
    joined = contracted(crossing)
    for done in (grouped, salted, placed, crossing, *tested):
        discard(done)
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("name", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("data").join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = saved(out)
    for done in (sizes, classes, joined):
        discard(done)
    return out


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for those that a smaller doc_id's component holds: one document of each stays.

    Repeated rows of the document that stays all stay, and so does a row without doc_id.
    """
    mark = unused("_tidemark_id", docs)
    found = near_duplicate_components(docs, id_col=id_col, text_col=text_col)
    gone = found.groupBy(F.col("doc_id").alias(mark)).agg(F.min("component_id").alias("least")).where(F.col("least") < F.col(mark)).select(mark)
    return docs.join(gone, F.col(id_col) == F.col(mark), "left_anti")
