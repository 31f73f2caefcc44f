import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import remove_repeats


def brute(docs):
    seen, out = {}, {}
    for doc, text in sorted((d, t or "") for d, t in docs):
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 99):
            key = data[i : i + 100]
            if key in seen and seen[key] < (doc, i):
                covered[i : i + 100] = b"\1" * 100
            seen.setdefault(key, (doc, i))
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out[doc] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, docs):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, n_bytes int").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [line(n) for n in (99, 100, 101, 150, 400)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else line(rng.randint(0, 200)))
        docs.append("".join(parts))
    docs += [docs[0], docs[1][:-1] + "!", "a" * 500, "ab" * 200, "a" * 350, line(40)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [1 << 20, 256])
def test_against_brute_force(spark, monkeypatch, block):
    docs = corpus(2) + [(900, None), (901, "")]
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    assert run(spark, docs) == brute(docs)


def test_cut_long_texts(spark):
    """A text longer than a block, with a repeat across the border."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 5000))
    docs = [(1, long), (2, "x" + long[(1 << 20) - 300 : (1 << 20) + 300])]
    assert run(spark, docs) == brute(docs)


def test_structured_texts(spark):
    """The Thue-Morse word and its complement, which polynomial hashes modulo 2**64 confuse when they are long."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    docs = [(1, word), (2, other), (3, word[:150]), (4, other[700:1200] + "c")]
    assert run(spark, docs) == brute(docs)


def test_rows_of_one_batch_in_any_order():
    """The earliest of equal rows is the first, however they come."""
    doc, lo = np.array([2, 1, 1, 2, 1]), np.array([5, 9, 3, 1, 3])
    same = np.zeros(5, np.uint64)
    (batch,) = suffix_dedup._emit(doc, same, same, lo, np.ones(5, int), np.zeros(5, int))
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lo", "known")), strict=True))
    assert rows == [(1, 3, False), (1, 3, False), (1, 9, True), (2, 1, True), (2, 5, True)]


def test_edges(spark):
    assert run(spark, []) == {}
    rows = remove_repeats(spark.createDataFrame([(None, "z" * 300), (1, "q" * 50 + "r" * 60), (1, "q" * 50 + "r" * 60)], "doc_id bigint, text string")).collect()
    assert len(rows) == 3 and all(r.n_removed == 0 for r in rows)


def test_spans_and_kept_bytes(spark):
    text = "".join(map(chr, range(200, 330)))
    rows = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, text), (2, "ab" + text + "cd")], "doc_id bigint, text string")).collect()}
    assert bytes(rows[2].kept) == b"abcd" and [tuple(s) for s in rows[2].spans] == [(2, 2 + len(text.encode()))]
    assert rows[1].spans == [] and rows[1].kept is None
