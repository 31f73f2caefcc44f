import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import WordIds, best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "it's", " ", "\n", "'LL", "é", "é", "<|endoftext|>", "<|ENDoftext|>", "12", "!!", " the", "日本", "\x1c", "\x00", "ΑΣ", "İ", "ß", "😀", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9) | st.text(max_size=20))
def test_ids_are_the_librarys(library, parts):
    text = "".join(parts)
    assert np.frombuffer(WordIds.open(PATH).ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(sizes):
    bins = best_fit(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fills = [sum(sizes[i] for i in b) for b in bins]
    assert all(f <= 20 for f in fills) and sum(f <= 10 for f in fills) <= 1


@pytest.mark.parametrize("fan_in, group_bins", [(8, 20_000), (2, 5)])
def test_rows(spark, library, fan_in, group_bins):
    rng = np.random.default_rng(1)
    texts = [None, "", "same", "same", "word " * 900] + ["on the " * int(n) for n in rng.integers(1, 40, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    rows = pack(docs, capacity=100, fan_in=fan_in, group_bins=group_bins).collect()
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(s, min(100, len(ids) - s)) for s in range(0, len(ids), 100)]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.05 * -(-total // 100) + (1 if group_bins > 5 else 12)
    assert pack(docs.where("false")).count() == 0


def test_items_that_never_fit_together(spark):
    docs = spark.createDataFrame([(k, "on " * 60) for k in range(30)], "doc_id bigint, text string").repartition(4)
    rows = pack(docs, capacity=100, group_bins=4).collect()
    assert len({r.sequence_id for r in rows}) == 30


def test_ids_of_every_code_point(library):
    """Each code point alone, after a sign and before a letter: the ids are the library's."""
    own = WordIds(PATH)
    texts = [f":{chr(c)}a" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(texts), 50_000):
        part = texts[start : start + 50_000]
        want = library.encode_batch(part, add_special_tokens=False)
        for text, w in zip(part, want, strict=True):
            assert np.frombuffer(own.ids(text), "<u4").tolist() == w.ids, ascii(text)


def test_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "on the", 7, 8), (None, None, 7, 8), (1, "on", 7, 8)], "doc_id bigint, text string, bin int, length int")
    rows = pack(docs, capacity=100).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 2), (True, 1), (True, 3)]


def test_lots_of_a_partition_and_tables_left(spark, monkeypatch):
    from pathlib import Path

    from tidemark.llm.common import discard, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    docs = spark.range(450_000, numPartitions=1).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    made = pack(docs)
    assert len(set(folder.iterdir()) - before) == 1
    rows = made.groupBy("sequence_id").agg({"offset": "max", "doc_id": "count"}).collect()
    assert len(rows) == -(-450_000 // 4096) and sum(r["count(doc_id)"] for r in rows) == 450_000
    discard(made)
    assert set(folder.iterdir()) <= before
