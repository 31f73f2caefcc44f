import random
import re
from itertools import combinations

import pytest

from tidemark.llm.decontaminate import find_overlaps, without_benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").lower())


def brute(docs, items, window=20, least=0.75):
    found = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            t = words(item)
            size = min(window, len(t))
            if d is None or i is None or len(t) < 10:
                continue
            for start in range(-len(t) + 1, len(w)):
                low, high = max(0, start), min(len(w), start + len(t))
                same = [w[k] == t[k - start] for k in range(low, high)]
                if any(sum(same[k : k + size]) >= least * size for k in range(len(same) - size + 1)):
                    found.add((d, i))
    return found


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    vocabulary = [f"é{k}w" for k in range(500)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, make(rng.randint(15, 60))) for k in range(20)]
    docs = []
    for d in range(80):
        text = make(rng.randint(0, 150))
        if d % 2:
            _, item = rng.choice(items)
            part = list(item)
            for _ in range(rng.randint(0, len(part) // 10)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(text))
            text = text[:at] + part + text[at:]
        docs.append((d, ", ".join(text).upper()))
    return docs + [(900, None), (901, ""), (None, " ".join(items[0][1]))], [(k, " ".join(x)) for k, x in items] + [(50, "too short"), (None, "n " * 30), (51, None)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 500])
def test_against_brute_force(spark, planted, block_bytes):
    docs, items = planted
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = find_overlaps(d, b, block_bytes=block_bytes).collect()
    got, want = {(r.doc_id, r.item_id) for r in rows}, brute(docs, items)
    assert len(rows) == len(got) and got <= want
    assert want <= got  # a tenth of the words changed leaves a seed of some mask
    kept = {r.doc_id for r in without_benchmark(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in want}


def test_edges(spark, planted):
    docs, items = planted
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert find_overlaps(d.where("false"), b).count() == 0
    assert find_overlaps(d, b.where("false")).count() == 0
    item = items[0][1]
    twice = spark.createDataFrame([(1, f"{item} and {item}"), (1, item), (2, "z " * 100_000 + item)], "doc_id bigint, text string")
    rows = sorted((r.doc_id, r.item_id, r.n_places) for r in find_overlaps(twice, b.union(b)).collect())
    assert rows == [(1, 0, 1), (1, 0, 2), (2, 0, 1)]


def test_neighbouring_rows_don_t_make_an_overlap(spark):
    item = " ".join(f"w{k}" for k in range(20))
    halves = [(1, " ".join(item.split()[:10])), (2, " ".join(item.split()[10:]))]
    d = spark.createDataFrame(halves, "doc_id bigint, text string").coalesce(1)
    assert find_overlaps(d, spark.createDataFrame([(0, item)], "item_id bigint, text string")).count() == 0


def changed(item, places):
    return " ".join(f"x{k}" if k in places else w for k, w in enumerate(item.split()))


def test_15_of_20_words_wherever_the_others_are(spark):
    item = " ".join(f"w{k}" for k in range(20))
    texts = [changed(item, set(places)) for places in combinations(range(20), 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert find_overlaps(docs, items).where("n_same = 15 and best_window = 15").count() == len(texts) == 15504
    six = spark.createDataFrame([(k, changed(item, set(range(k, 20, 3)[:6]))) for k in range(3)], docs.schema)
    assert find_overlaps(six, items).count() == 0


def test_every_fourth_word_changed(spark):
    item = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(k, changed(item, set(range(k, 200, 4)))) for k in range(4)], "doc_id bigint, text string")
    found = find_overlaps(docs, spark.createDataFrame([(0, item)], "item_id bigint, text string"))
    assert [r.n_same for r in found.orderBy("doc_id").collect()] == [150] * 4


def test_items_of_any_length(spark):
    """Each item under 20 words by itself, with all sets of a quarter of its words changed."""
    docs, items = [], []
    for n in range(1, 20):
        item = " ".join(f"n{n}w{k}" for k in range(n))
        items.append((n, item))
        docs += [(n, changed(item, set(places))) for places in combinations(range(n), n // 4)]
        # With one more changed it is no overlap.
        docs.append((-n, changed(item, set(range(n // 4 + 1)))))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = find_overlaps(d, b).collect()
    assert all(r.doc_id == r.item_id for r in rows) and len(rows) == sum(k > 0 for k, _ in docs)
