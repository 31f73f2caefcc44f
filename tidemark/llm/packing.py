"""Packing of tokenised documents into sequences of bounded length, by hierarchical best fit.

Partitions pack their own pieces by best fit and emit the bins that are nearly
full.  The rest go on as items: a tree of rounds merges the underfull bins of
ever more partitions, each group again by best fit, until one group is left or
a round joins nothing more.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import discard, saved, slices
from .token_counts import byte_letters

#: Characters whose class, case and composition no version of Unicode has changed: ASCII and
#: the letters of Latin-1 and Latin Extended-A, but for the capital I with a dot, which has two in lower case.
SURE = "\x00-\x7fÀ-ÖØ-öø-įı-ſ"
#: Fixed value of the tokenizer's format: its words, as far as they are of those, in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t-\ra-zß-öø-ſ0-9]+")
#: Runs without ASCII white space that hold another character.
BEYOND = re.compile(rf"([^ \t-\r]*[^{SURE}][^ \t-\r]*)")
KEPT_WORDS = 300_000
KEPT_LETTERS = 64
#: Pieces that a task packs at a time, and holds as Python objects.
LOT = 200_000


class WordIds:
    """Ids of whole texts by a tokenizer file that lower-cases and drops white space.

    White space always ends a word, and neither normalising nor merging reaches
    across it.  So a text's ids are those of its parts between white space.  A
    part goes to the library whole, which alone knows its version of Unicode,
    unless it is of the sure characters; those are cut into words here, which go
    to the library's model.  The ids of short parts and words seen before are
    kept, up to a bound.
    """

    _open: dict[str, WordIds] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        specials = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.known: dict[str, bytes] = {}

    @classmethod
    def open(cls, path: str) -> WordIds:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _keep(self, part: str, ids: list[int]) -> bytes:
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= KEPT_LETTERS:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[part] = found
        return found

    def _whole(self, part: str) -> bytes:
        return self._keep(part, self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        return self._keep(word, [token.id for token in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def ids(self, text: str) -> bytes:
        """The library's ids as little-endian unsigned 32-bit integers."""
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, out = self.known, []
        for k, part in enumerate(BEYOND.split(text)):
            if k % 2:
                out.append(known.get(part) or self._whole(part))
            else:
                out += [known.get(word) or self._word(word) for word in WORDS.findall(part.lower())]
        return b"".join(out)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest item first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # what is left in the open bins, sorted
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
            bins[number].append(item)
        else:
            left, number = capacity, len(bins)
            bins.append([item])
        if left > size:
            insort(room, (left - size, number))
    return bins


def _tokenised(source: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces, each with the bin of its partition and its place there; a task packs a lot of pieces at a time."""
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        ids_of = WordIds.open(path).ids
        rows: list[tuple] = []
        bins_before = 0

        def packed(last: bool) -> pa.RecordBatch:
            """The pieces in their bins; those of the emptiest bins wait for the next lot."""
            nonlocal bins_before
            bins = best_fit([row[3] for row in rows], capacity)
            bins.sort(key=lambda items: -sum(rows[item][3] for item in items))
            waiting: list[tuple] = []
            while not last and len(bins) > 1 and len(waiting) + len(bins[-1]) <= LOT // 8:
                waiting += [rows[item] for item in bins.pop()]
            made = []
            for k, items in enumerate(bins):
                ends = list(accumulate((rows[item][3] for item in items), initial=0))
                made += [(*rows[item], bins_before + k, at, ends[-1]) for item, at in zip(items, ends, strict=False)]
            bins_before += len(bins)
            rows[:] = waiting
            kinds = (batch_type, pa.int32(), *[pa.int64()] * 6)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "number", "offset", "fill"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        for batch in slices(batches, 1024):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (ids_of(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if len(rows) >= LOT:
                        yield packed(False)
        if rows:
            yield packed(True)

    kind = source.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    made = source.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint, offset bigint, fill bigint")
    # A task's number goes into the upper half, so that bins of all partitions differ.
    return made.withColumn("bin", F.shiftleft(F.spark_partition_id().cast("bigint"), 32) + F.col("number")).drop("number")


def _merge(batch: pa.Table, capacity: int) -> pa.Table:
    """Best fit of one group's underfull bins: each goes into the first bin of its new sequence."""
    bins, fill = batch.column("bin").to_pylist(), batch.column("fill").to_pylist()
    into, base, total = list(bins), [0] * len(bins), list(fill)
    for items in best_fit(fill, capacity):
        at = 0
        for item in items:
            into[item], base[item] = bins[items[0]], at
            at += fill[item]
        for item in items:
            total[item] = at
    return pa.table({"bin": pa.array(bins, pa.int64()), "into": pa.array(into, pa.int64()), "base": pa.array(base, pa.int64()), "total": pa.array(total, pa.int64())})


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None, nearly_full: float = 0.995, group_bins: int = 20_000, fan_in: int = 8) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece of each document.

    A document is its token ids and ``end_id``; only one longer than ``capacity``
    is cut.  A null or empty text is the end id alone.  Repeated rows are packed
    each; an empty table gives no rows; other columns are not read.  The result
    is a written table.

    nearly_full: bins at least so full are closed.  group_bins: underfull bins
    that one task of a round packs at most.  fan_in: how many groups of a round
    meet in one of the next.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = saved(_tokenised(source, path, capacity, end_id))
    # Where each bin of the first round has come to: its sequence, its place there, the sequence's length.
    places = pieces.groupBy("bin").agg(F.max("fill").alias("total")).select("bin", F.col("bin").alias("sequence"), F.lit(0).cast("bigint").alias("base"), "total")
    first = saved(places)
    places, open_bins = first, first.where(F.col("total") < int(nearly_full * capacity)).select("bin", F.col("total").alias("fill"))
    groups = 1 << 30
    moves: list[DataFrame] = []
    while True:
        count = open_bins.count()
        least = -(-count // group_bins)
        groups = max(least, min(-(-groups // fan_in), -(-count // 2000)))
        if count < 2:
            break
        # Groups get bins of all sizes alike: dealt by a hash of the bin.
        dealt = open_bins.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        merged = saved(dealt.groupBy("group").applyInArrow(lambda t: _merge(t, capacity), "bin bigint, into bigint, base bigint, total bigint"))
        moves.append(merged)
        open_bins = merged.where((F.col("bin") == F.col("into")) & (F.col("total") < int(nearly_full * capacity))).select("bin", F.col("total").alias("fill"))
        if groups == 1 or (groups == least and not merged.where("bin <> into").limit(1).count()):
            break
    for merged in moves:
        step = merged.select(F.col("bin").alias("sequence"), "into", F.col("base").alias("more"))
        places = places.join(step, "sequence", "left").select("bin", F.coalesce("into", "sequence").alias("sequence"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"), "total")
    out = saved(pieces.join(places.select("bin", "sequence", "base"), "bin").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), (F.col("base") + F.col("offset")).alias("offset")))
    for step in (pieces, first, *moves):
        discard(step)
    return out
