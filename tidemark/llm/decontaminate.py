"""Benchmark decontamination by spaced seeds.

Fixed masks over a few consecutive words ignore some of the positions, so a
hash of the rest survives a substituted word.  The masks are such that every
overlap asked for holds a seed, wherever its changed words are.  Training hashes
are joined to the benchmark's; around each hit the two texts are laid over each
other and the overlap is verified, substitutions allowed.

The benchmark is a stated query set: it is read in blocks of bounded size, and
each block is held against all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused
from .kernels import ALNUM, chunks, masked_hashes, text_buffer, word_hashes

#: Fixed masks: words at a 0 may differ.  One of them is free of changed words in
#: each of the ways to change at most 5 of 20 words.
MASKS = ("111011", "1110001001", "11111")
#: Hits that are looked at together.
HITS = 1 << 15


def masks_for(size: int, need: int) -> tuple[str, ...]:
    """Masks one of which falls on equal words wherever ``need`` of ``size`` words are equal."""
    changed = size - need
    # The changed words leave changed + 1 runs, the longest of this many words at least.
    run = max(1, -(-need // (changed + 1)))
    if run < 5 and size >= 20 and changed <= 5:
        return MASKS
    return ("1" * min(run, 10),)


class Index:
    """The seeds of one mask in a block's items."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.places = hashes[order], items[order], places[order]
        # First look: whether any seed has the same upper 16 bits.
        self.upper = np.zeros(1 << 16, bool)
        self.upper[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray):
        """Items hit, the seed's place in them and in the text, a bounded number at a time."""
        at = np.flatnonzero(self.upper[(seeds >> np.uint64(48)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, seeds[at], "left"), np.searchsorted(self.hashes, seeds[at], "right")
        at, low, counts = at[high > low], low[high > low], (high - low)[high > low]
        ends = np.cumsum(counts)
        for first in range(0, int(ends[-1]) if len(ends) else 0, HITS):
            number = np.arange(first, min(first + HITS, int(ends[-1])))
            seed = np.searchsorted(ends, number, "right")
            entry = low[seed] + number - (ends - counts)[seed]
            yield self.items[entry], self.places[entry], at[seed]


class Block:
    """Some benchmark items: their words and an index of their seeds."""

    def __init__(self, ids: list, texts: list[str], window: int = 20, least: float = 0.75):
        self.ids = ids
        data, offsets = text_buffer(pc.utf8_lower(pa.array(texts, pa.string())))
        self.words, self.at = word_hashes(data, offsets, ALNUM)
        self.sizes = np.minimum(np.diff(self.at), window)
        self.needs = np.array([math.ceil(least * int(size)) for size in self.sizes], np.int64)
        made: dict[str, list] = {}
        for item, (start, end) in enumerate(zip(self.at[:-1], self.at[1:], strict=True)):
            for mask in masks_for(int(self.sizes[item]), int(self.needs[item])) if self.sizes[item] > 0 else ():
                h = masked_hashes(self.words[start:end], mask, 1)
                made.setdefault(mask, []).append((h, np.full(len(h), item), np.arange(len(h))))
        self.indexes = {mask: Index(*(np.concatenate(x) for x in zip(*parts, strict=True))) for mask, parts in made.items()}

    def likely(self, words: np.ndarray, items: np.ndarray, places: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
        """Of these hits, which have a window around the seed that holds enough equal words; rows are not told apart."""
        keep = np.zeros(len(items), bool)
        for size in np.unique(self.sizes[items]).tolist():
            of = np.flatnonzero(self.sizes[items] == size)
            reach = np.arange(span - size, size)
            mine, theirs = at[of, None] + reach, places[of, None] + reach
            inside = (mine >= 0) & (mine < len(words)) & (theirs >= 0) & (theirs < np.diff(self.at)[items[of], None])
            theirs = theirs + self.at[items[of], None]
            same = inside & (words[np.clip(mine, 0, len(words) - 1)] == self.words[np.clip(theirs, 0, len(self.words) - 1)])
            sums = np.zeros((len(of), len(reach) + 1), np.int32)
            np.cumsum(same, axis=1, out=sums[:, 1:])
            keep[of] = (sums[:, size:] - sums[:, :-size]).max(axis=1) >= self.needs[items[of]]
        return keep

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items hit and where in the text they would begin, each pair once."""
        found = [np.zeros((2, 0), np.int64)]
        for mask, index in self.indexes.items():
            # Seeds that cross from one row into the next hit nothing that verification would keep.
            for items, places, at in index.hits(masked_hashes(words, mask, 1)):
                keep = self.likely(words, items, places, at, len(mask))
                found.append(np.unique(np.stack([items[keep], (at - places)[keep]]), axis=1))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def overlap(self, words: np.ndarray, item: int, start: int, window: int, least: float) -> tuple[int, int]:
        """Equal words where the item lies over the text from ``start`` on, and those of its best window.

        The window is ``window`` words, or the item if that is shorter; a window
        that holds ``least`` of them is an overlap, otherwise 0 is returned.
        """
        theirs = self.words[self.at[item] : self.at[item + 1]]
        low, high = max(0, start), min(len(words), start + len(theirs))
        window = min(window, len(theirs))
        same = words[low:high] == theirs[low - start : high - start]
        if len(same) < window or not window:
            return 0, 0
        sums = np.concatenate([[0], np.cumsum(same)])
        best = int((sums[window:] - sums[:-window]).max())
        return (int(same.sum()), best) if best >= least * window else (0, 0)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, least: float = 0.75, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, item_id, n_places, n_words, n_same, best_window`` for each document that holds a benchmark item.

    A document holds an item where a window of ``window`` consecutive words of it
    (all, if it has fewer) stands with at least ``least`` of the words equal at
    their positions; each such place is found.  n_places counts the places, n_same
    is the most equal words at one place, n_words the item's length.  Words are
    runs of letters, digits and non-ASCII characters, case ignored.  An item
    without words is found nowhere, nor is a null or empty text, a null id on
    either side, or anything in an empty table.  Repeated rows of docs count
    each as documents of their own; repeated items are reported each once.

    block_bytes: benchmark text that is held against the documents at once; it
    bounds what the driver and the tasks hold.  Larger benchmarks take more
    passes.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    id_type, item_type = source.schema["doc_id"].dataType, items.schema["item_id"].dataType
    kind, item_kind = id_type.simpleString(), item_type.simpleString()
    running = 0
    found: DataFrame | None = None

    def search(block: Block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            block = shared.value
            for batch in batches:
                data, offsets = text_buffer(pc.utf8_lower(batch.column(1)))
                rows = []
                for low, high in chunks(offsets):
                    inner = offsets[low : high + 1] - offsets[low]
                    words, at = word_hashes(data[offsets[low] : offsets[high]], inner, ALNUM)
                    hit_items, begins = block.hits(words)
                    if not len(hit_items):
                        continue
                    # The row of a hit is that of its middle; an item may begin before its row does.
                    for item, begin in zip(hit_items.tolist(), begins.tolist(), strict=True):
                        length = int(block.at[item + 1] - block.at[item])
                        first = max(0, int(np.searchsorted(at, begin, "right")) - 1)
                        for row in range(first, high - low):
                            if at[row] >= begin + length:
                                break
                            same, best = block.overlap(words[at[row] : at[row + 1]], item, begin - int(at[row]), window, least)
                            if best:
                                rows.append((low + row, item, length, same, best))
                ids = batch.column(0).to_pylist()
                merged: dict[tuple[int, int], list[int]] = {}
                for row, item, length, same, best in rows:
                    entry = merged.setdefault((row, item), [0, length, 0, 0])
                    entry[0] += 1
                    entry[2], entry[3] = max(entry[2], same), max(entry[3], best)
                out = [(ids[row], block.ids[item], *entry) for (row, item), entry in merged.items()]
                kinds = (to_arrow_type(id_type), to_arrow_type(item_type), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["doc_id", "item_id", "n_places", "n_words", "n_same", "best_window"])

        return source.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, n_places bigint, n_words bigint, n_same bigint, best_window bigint")

    ids: list = []
    texts: list[str] = []
    for row in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        running += len(row.text)
        if running >= block_bytes:
            part = search(Block(ids, texts, window, least))
            found = part if found is None else found.unionByName(part)
            ids, texts, running = [], [], 0
    if ids or found is None:
        part = search(Block(ids, texts, window, least))
        found = part if found is None else found.unionByName(part)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs but for those whose doc_id holds a benchmark item; a row without doc_id stays."""
    id_col = options.get("id_col", "doc_id")
    mark = unused("_tidemark_id", docs)
    held = find_overlaps(docs, benchmark, **options).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(held, F.col(id_col) == F.col(mark), "left_anti")
