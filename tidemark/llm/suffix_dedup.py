"""Removal of byte strings that stand earlier too, by ranks of growing prefixes of sampled positions.

Positions are ranked by prefixes of three lengths, and leave as soon as their
rank is their own, or the threshold of 100 bytes is reached.  Prefix doubling
would rank every position first, which shuffles many times the text (README has
the figures); here most positions never are.  Ranks are names by content, so a
length's ranks come from the text itself.  Spark sorts positions by them:

* 40 bytes, at sampled positions.  Each 100-byte string has one anchor, the
  place of its least 40-byte hash, the same wherever the string stands;
  consecutive strings share theirs and make a run.  An anchor whose rank is
  unique leaves with its run.
* 93 bytes (pairs of ranks at p and p + 47), for cells of eight consecutive
  strings of the runs left: the bytes all eight share.  A unique rank leaves with
  its cell.
* 100 bytes (pairs of ranks at p and p + 50), for the single strings of the cells
  left.

Runs and cells of equal rank whose bytes are the same from end to end are
decided at once, all but the first being repeats; only the first of each kind
goes on.  For later lengths the places left are joined to their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved
from .kernels import _Powers, mix, text_buffer

LENGTH = 100
FIRST = 40
SPAN = LENGTH - FIRST + 1
CELL = 8
BLOCK = 1 << 20

_U = np.uint64
_ROWS = "key bigint, ctx bigint, doc_id bigint, lo bigint, n int, anchor int, known boolean"
_NAMES = ["key", "ctx", "doc_id", "lo", "n", "anchor", "known"]
_OPEN = ("lo", "n", "anchor")


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    forward, _ = _Powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * forward[: len(data)], out=total[1:])
    return total


def _ranks(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of substrings by content; with 64 bits they stand for ranks, and any two are compared by them."""
    _, backward = _Powers.upto(len(total))
    return mix((total[ends] - total[starts]) * backward[starts] + (ends - starts).astype(_U))


def anchor_runs(data: np.ndarray, total: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive 100-byte strings with one anchor: (key, ctx, first start, how many, anchor).

    data holds several texts, the k-th from starts[k] to ends[k]; total its prefix sums.
    """
    none = tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    count = len(data) - LENGTH + 1
    if count <= 0:
        return none
    _, backward = _Powers.upto(len(total))
    grams = mix((total[FIRST:] - total[:-FIRST]) * backward[: len(data) - FIRST + 1])
    # The hash's upper bits, then the place: the least is the leftmost of the least hashes.
    least = ((grams >> _U(22)) << _U(22)) | np.arange(len(grams), dtype=_U)
    have = 1
    while have < SPAN:
        step = min(have, SPAN - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & _U((1 << 22) - 1)).astype(np.int64)
    valid = np.zeros(count + 1, np.int64)
    whole = ends - starts >= LENGTH
    valid[starts[whole]] += 1
    np.subtract.at(valid, ends[whole] - LENGTH + 1, 1)
    valid = np.cumsum(valid[:-1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    anchor = anchor[at]
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    n = np.diff(np.append(begin, len(at)))
    lo, anchor = at[begin], anchor[begin]
    spans = _ranks(total, lo, lo + n - 1 + LENGTH)
    return grams[anchor], mix(spans + (anchor - lo).astype(_U) * _U(0x9E3779B97F4A7C15)), lo, n, anchor


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts[k] parts of k: k, and the part's number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def cells_of(total: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of runs, cut at fixed distances before the anchor, which stands ``anchor`` bytes after lo: (key, ctx, first start, how many, 0)."""
    near, far = (anchor - n + 1) // CELL, anchor // CELL
    of, part = _spread(far - near + 1)
    end = (lo + anchor)[of] - CELL * (near[of] + part)  # the grid's last start of the cell
    first, last = np.maximum(lo[of], end - CELL + 1), np.minimum(lo[of] + n[of] - 1, end)
    middle, core = end + (LENGTH - CELL + 2) // 2, end + LENGTH - CELL + 1
    key = mix(_ranks(total, end, middle) + _ranks(total, middle, core) * _U(0x9E3779B97F4A7C15))
    ctx = mix(_ranks(total, first, last + LENGTH) + (end - first).astype(_U) * _U(0x9E3779B97F4A7C15))
    return key, ctx, first, last - first + 1, np.zeros(len(first), np.int64)


def strings_of(total: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Single strings of cells: the pair of their halves' ranks, and where they start."""
    of, part = _spread(n)
    start = lo[of] + part
    half = start + LENGTH // 2
    return _ranks(total, start, half), _ranks(total, half, start + LENGTH), start, np.ones(len(start), np.int64), np.zeros(len(start), np.int64)


def _pieces(offsets: np.ndarray, order: np.ndarray):
    """Row numbers and the byte ranges of their texts, in lots of about one block; a longer text is cut with 99 bytes of overlap."""
    lot: list[tuple[int, int, int]] = []
    size = 0
    for row in order.tolist():
        low, high = int(offsets[row]), int(offsets[row + 1])
        while high - low >= LENGTH:
            take = min(high, low + BLOCK + LENGTH - 1)
            if lot and size + take - low > BLOCK:
                yield lot
                lot, size = [], 0
            lot.append((row, low, take))
            size += take - low
            low = take - LENGTH + 1 if take < high else high
    if lot:
        yield lot


def _first_known(doc: np.ndarray, key: np.ndarray, ctx: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Marks rows, in order of document and place, that repeat one from an earlier place of the batch."""
    mixed = mix(key + ctx * _U(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    known = np.zeros(len(key), bool)
    known[order] = (doc[order] != doc[first]) | (lo[order] != lo[first])
    return known


def _emit(doc: np.ndarray, key: np.ndarray, ctx: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray):
    """Rows of one batch.  Repeats within it are decided here, which spares the sort the groups of many copies."""
    if ((doc[1:] < doc[:-1]) | ((doc[1:] == doc[:-1]) & (lo[1:] < lo[:-1]))).any():
        order = np.lexsort((lo, doc))
        doc, key, ctx, lo, n, anchor = (c[order] for c in (doc, key, ctx, lo, n, anchor))
    known = _first_known(doc, key, ctx, lo)
    key = np.where(known, mix(doc.astype(_U)), key)  # decided rows go anywhere
    columns = (key.view(np.int64), ctx.view(np.int64), doc, lo, n.astype(np.int32), anchor.astype(np.int32), known)
    for at in range(0, len(doc), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=_NAMES)


def _lots(batch: pa.RecordBatch):
    """The texts of a batch in lots: bytes, their prefix sums, where texts end and begin, their rows, and what to add to a place for its text's own."""
    data, offsets = text_buffer(batch.column("text"))
    ids = batch.column("doc_id").to_numpy()
    for lot in _pieces(offsets, np.argsort(ids, kind="stable")):
        joined = np.concatenate([data[low:high] for _, low, high in lot])
        lengths = np.array([high - low for _, low, high in lot])
        ends = np.cumsum(lengths)
        rows = np.array([r for r, _, _ in lot])
        shift = np.array([low for _, low, _ in lot]) - (ends - lengths) - offsets[rows]
        yield joined, _prefix_sums(joined), ends, ends - lengths, rows, shift


def runs_level(source: DataFrame) -> DataFrame:
    """Rows to rank of all runs."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            out = []
            for joined, total, ends, starts, rows, shift in _lots(batch):
                key, ctx, lo, n, anchor = anchor_runs(joined, total, ends, starts)
                text = np.searchsorted(ends, lo, "right")
                out.append((ids[rows[text]], key, ctx, lo + shift[text], n, anchor - lo))
            if out:
                yield from _emit(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return source.mapInArrow(run, _ROWS)


def next_level(source: DataFrame, left: DataFrame, cut: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows to rank of the parts that ``cut`` makes of what ``left`` has open, in the texts that have such.

    A text meets the open places of its doc_id; those beyond its end, of another
    text with that id, are passed over.
    """
    open_places = left.where("open").groupBy("doc_id").agg(F.collect_list(F.struct(*_OPEN)).alias("places"))
    texts = source.join(open_places, "doc_id").select("doc_id", "text", "places")

    def run(batches):
        for batch in batches:
            ids, places = batch.column("doc_id").to_numpy(), batch.column("places")
            counts = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends_of = np.cumsum(counts)
            lo_all, n_all, anchor_all = (places.flatten().field(c).to_numpy().astype(np.int64) for c in _OPEN)
            out = []
            for _, total, ends, starts, rows, shift in _lots(batch):
                of, part = _spread(counts[rows])
                at = (ends_of[rows] - counts[rows])[of] + part
                lo, n, anchor = lo_all[at] - shift[of], n_all[at], anchor_all[at]
                inside = (lo >= starts[of]) & (lo + n - 1 + LENGTH <= ends[of])
                key, ctx, lo, n, anchor = cut(total, lo[inside], n[inside], anchor[inside])
                text = np.searchsorted(ends, lo, "right")
                out.append((ids[rows[text]], key, ctx, lo + shift[text], n, anchor))
            if out:
                yield from _emit(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return texts.mapInArrow(run, _ROWS)


def ranked(rows: DataFrame) -> DataFrame:
    """``doc_id, lo, n, anchor, open``: repeats (not open), and the first of each kind where one key has several kinds.

    Rows come sorted by key, kind, document and place, as a stream: a group's
    size takes no memory.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        last_key = last_ctx = None
        place = np.zeros((2, 1), np.int64)  # of the first row of the last kind
        pending = None  # the first row of the last key, as long as no second kind has come
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            doc, lo, n, anchor = (batch.column(c).to_numpy() for c in ("doc_id", "lo", "n", "anchor"))
            repeats = [np.stack([doc[known], lo[known], n[known], anchor[known]])]
            opened = []
            rest = ~known
            doc, lo, n, anchor = doc[rest], lo[rest], n[rest], anchor[rest]
            key, ctx = batch.column("key").to_numpy()[rest], batch.column("ctx").to_numpy()[rest]
            if len(key):
                new_key, new_ctx = np.ones(len(key), bool), np.ones(len(key), bool)
                new_key[1:] = key[1:] != key[:-1]
                new_ctx[1:] = new_key[1:] | (ctx[1:] != ctx[:-1])
                if last_key is not None and key[0] == last_key:
                    new_key[0], new_ctx[0] = False, ctx[0] != last_ctx
                last_key, last_ctx = key[-1], ctx[-1]
                # Rows of the first one's own place, of a document that is there twice, repeat nothing.
                at = np.maximum.accumulate(np.where(new_ctx, np.arange(1, len(key) + 1), 0))
                firsts = np.concatenate([place, np.stack([doc, lo])], axis=1)[:, at]
                place = firsts[:, -1:]
                again = (doc != firsts[0]) | (lo != firsts[1])
                repeats.append(np.stack([doc[again], lo[again], n[again], anchor[again]]))
                f = np.flatnonzero(new_ctx)
                if len(f):
                    of_key = new_key[f]
                    if pending is not None and not of_key[0]:
                        opened.append(pending)
                    send = ~of_key
                    send[:-1] |= ~of_key[1:]
                    opened.append(np.stack([doc[f[send]], lo[f[send]], n[f[send]], anchor[f[send]]]))
                    pending = np.array([[doc[f[-1]]], [lo[f[-1]]], [n[f[-1]]], [anchor[f[-1]]]]) if of_key[-1] else None
            sent = [np.concatenate(x, axis=1) if x else np.zeros((4, 0), np.int64) for x in (repeats, opened)]
            both = np.concatenate(sent, axis=1)
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2].astype(np.int32)), pa.array(both[3].astype(np.int32)), pa.array(np.arange(both.shape[1]) >= sent[0].shape[1])], names=["doc_id", "lo", "n", "anchor", "open"])

    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "ctx", "doc_id", "lo")
    return dealt.mapInArrow(run, "doc_id bigint, lo bigint, n int, anchor int, open boolean")


def repeated_runs(source: DataFrame) -> DataFrame:
    """``doc_id, runs``: in each run (lo, n) the n 100-byte strings from byte lo on stand earlier too."""
    runs = saved(ranked(runs_level(source)))
    cells = saved(ranked(next_level(source, runs, cells_of)))
    strings = saved(ranked(next_level(source, cells, strings_of)))
    levels = (runs, cells, strings)
    found = runs.union(cells).union(strings).where("not open")
    per_doc = saved(found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("runs")))
    for table in levels:
        discard(table)
    return per_doc


def _merged(runs: list[dict], size: int) -> np.ndarray:
    """Maximal removed spans (start, end) of a text."""
    lo = np.array([r["lo"] for r in runs], np.int64)
    hi = np.minimum(lo + np.array([r["n"] for r in runs], np.int64) + LENGTH - 1, size)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > hi[:-1]
    begin = np.flatnonzero(first)
    spans = np.stack([lo[begin], hi[np.append(begin[1:], len(lo)) - 1]], axis=1)
    return spans[spans[:, 0] < spans[:, 1]]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256`` of each row's whole text.

    Every byte that a 100-byte string covers which also starts earlier, in a
    smaller doc_id or before in the same text, is removed; strings are judged on
    the input.  spans holds the removed runs (start, end), kept the remaining
    bytes where some were removed, else null.  A null text counts as empty.  A
    row without doc_id is compared with nothing and keeps all.  Rows that share
    a doc_id stand at the same place, so none is earlier than the other; each
    loses what was found in any of them, as far as it is that long.  Repeated
    rows come back each; an empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    given = source.where("doc_id is not null and text is not null")
    runs = repeated_runs(given)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = (text or "").encode()
                spans = _merged(runs, len(data)) if runs else np.zeros((0, 2), np.int64)
                kept = None
                if len(spans):
                    edges = [0, *spans.ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sha = hashlib.sha256(data if kept is None else kept).hexdigest()
                out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), [{"start": a, "end": b} for a, b in spans.tolist()], kept, sha))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    joined = source.join(runs, "doc_id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")
