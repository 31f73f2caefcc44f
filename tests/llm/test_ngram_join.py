import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import least_difference, least_overlap, near_duplicate_components, parts_allow, prefix_length, shared_count, signature, suffix_allows, without_near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, groups=8, copies=14, words=60, edits=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(25)]  # a passage that all groups have
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)] + shared
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append(" ".join(text))
    rng.shuffle(docs)
    return list(enumerate(docs))


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, name string, n int").repartition(3)
    return df, {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(df).collect()}


def test_against_brute_force(spark):
    docs = near_copies(1)
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b c"), (1004, "A B C"), (1005, "a b"), (1006, "one"), (1007, "é é é é é é"), (1008, "\x00 \x1c a b c d")]
    docs += [(1010 + k, "long " * 20 + " ".join(map(str, range(30_000)))) for k in range(2)]
    df, got = run(spark, docs)
    assert got == brute(docs)
    kept = {r.doc_id for r in without_near_duplicates(df).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_a_chain_is_one_component(spark):
    words = [f"v{k}" for k in range(80)]
    docs = []
    for k in range(12):
        words = words[3:] + [f"n{k}a", f"n{k}b", f"n{k}c"]
        docs.append((k, " ".join(words)))
    _, got = run(spark, docs)
    assert got == brute(docs) and {c for _, c in got.values()} == {0}


def test_edges(spark):
    assert run(spark, [])[1] == {}
    rows = near_duplicate_components(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("1", 1), ("1", 1), ("2", 1), ("None", None)]


sets = st.sets(st.integers(0, 63), max_size=40).map(lambda s: np.array(sorted(s), np.uint64) << np.uint64(58))


@given(sets, sets)
def test_filters_keep_all_links(x, y):
    shared = len(set(x.tolist()) & set(y.tolist()))
    assert shared_count(x, y) == shared
    assert parts_allow(signature(x), signature(y), shared)
    linked = len(x) + len(y) > 0 and 100 * shared >= 75 * (len(x) + len(y) - shared)
    assert linked == (len(x) + len(y) > 0 and shared >= least_overlap(len(x), len(y)))
    if linked:
        assert set(x[: prefix_length(len(x))].tolist()) & set(y[: prefix_length(len(y))].tolist())


def test_structured_words_are_told_apart(spark):
    """The Thue-Morse word of 1,024 letters and its complement, which polynomial hashes modulo 2**64 confuse."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    _, got = run(spark, [(1, word), (2, other), (3, word[:512] + other[:511]), (4, word)])
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 1)}


@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(0, 40))
def test_the_suffix_filter_lets_every_linked_pair_through(x, y, most):
    a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
    true = len(x ^ y)
    bound = least_difference(a, b, most)
    assert bound <= true
    assert least_difference(a, b, 1000, 20) == true
    if 100 * len(x & y) >= 75 * len(x | y):
        assert suffix_allows(a, b) and suffix_allows(b, a)


def test_one_n_gram_in_thousands_of_unrelated_texts(spark):
    """Texts that share a passage and nothing else, of one length: none is linked, and two planted copies are."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    docs = [(k, " ".join(["this common passage stands everywhere", *(word() for _ in range(6))])) for k in range(3000)]
    base = ["this common passage stands everywhere", *(word() for _ in range(40))]
    docs += [(5000, " ".join(base)), (5001, " ".join([*base, "more"]))]
    _, got = run(spark, docs)
    assert {d: c for d, (_, c) in got.items() if d != c} == {5001: 5000}


def test_with_more_representatives_than_a_filter_holds(spark, monkeypatch):
    """Beyond the filter's bound copies are left out by a join; the result is the same."""
    from tidemark.llm.common import BitFilter

    monkeypatch.setattr(BitFilter, "fitting", classmethod(lambda cls, *args: None))
    docs = near_copies(2, groups=4, copies=6)
    docs += [(500 + k, docs[0][1]) for k in range(5)]
    assert run(spark, docs)[1] == brute(docs)


def test_groups_dealt_by_document(spark, monkeypatch):
    """With n-grams salted from three of a bucket on, links and components are the same."""
    from tidemark.llm import ngram_join

    docs = near_copies(3, groups=5, copies=10)
    docs += [(700 + k, "this passage stands in each text " + " ".join(f"x{k}y{j}" for j in range(3))) for k in range(30)]
    assert run(spark, docs)[1] == brute(docs)
    monkeypatch.setattr(ngram_join, "hot_bucket", lambda levels, parts: 3.0)
    assert run(spark, docs)[1] == brute(docs)


def test_the_bound_of_a_hot_bucket_grows_with_the_input():
    from tidemark.llm.ngram_join import HOT_BUCKET, SKETCH_BITS, hot_bucket, salts_of

    levels = np.zeros(1 << SKETCH_BITS, np.uint16)
    assert hot_bucket(levels, 10) == HOT_BUCKET
    levels[:] = 256 * 10  # 1,023 in each bucket, 4.3 billion in all
    assert round(hot_bucket(levels, 1_000_000)) == 8 * 1023
    assert round(hot_bucket(levels, 1_000)) == round(1023 * len(levels) / 64_000)
    levels[5] = 256 * 30
    token = np.array([5 << 42, 6 << 42], np.uint64).view(np.int64)
    salts = salts_of(token, levels, hot_bucket(levels, 1_000_000))
    assert salts[1] == 1 and 50_000 < salts[0] < (1 << 30) / 8183


def test_pairs_of_a_group_whose_pivot_is_unlike_do_not_grow_with_its_square(spark, monkeypatch):
    """300 texts without a few of their lines: pivots link few of them, so the last round alone would make 21,026 pairs."""
    from tidemark.llm import ngram_join

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    docs = []
    for d in range(300):
        lines = [line for line in (base[i : i + 8] for i in range(0, 160, 8)) if rng.random() < 0.92] or [base[:8]]
        words = [word for line in lines for word in line]
        for _ in range(2):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(words)))
    made, filtered = [], ngram_join.parts_filtered

    def counted(pairs, signatures):
        made.append(pairs.count())
        return filtered(pairs, signatures)

    monkeypatch.setattr(ngram_join, "parts_filtered", counted)
    assert run(spark, docs)[1] == brute(docs)
    assert sum(made) < 12_000 and len(made) > 2


def test_only_groups_that_are_open_are_placed_again(spark, monkeypatch):
    """Pairs of texts that share a passage have no pair left behind the pivots, and a round joins no posting of groups that are one component."""
    from tidemark.llm import ngram_join

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    for _ in range(150):
        passage = [word() for _ in range(30)]
        docs += [" ".join([*passage, *(word() for _ in range(70))]) for _ in range(2)]
    base = [word() for _ in range(160)]
    for _ in range(60):
        docs.append(" ".join(w for i in range(0, 160, 8) if i == 0 or rng.random() < 0.92 for w in base[i : i + 8]))
    for _ in range(40):
        docs.append(" ".join([*base[:8], *(word() for _ in range(60))]))
    docs = list(enumerate(docs))
    placed, place = [], ngram_join._placed

    def counted(*args):
        out = place(*args)
        placed.append((out.count(), out.groupBy("token").count().where("count < 3").count()))
        return out

    monkeypatch.setattr(ngram_join, "_placed", counted)
    monkeypatch.setattr(ngram_join, "MEETINGS", 0)
    assert run(spark, docs)[1] == brute(docs)
    assert len(placed) > 1 and not any(small for _, small in placed)
    assert placed[-1][0] < placed[0][0]


def test_groups_of_a_stream_in_batches_of_any_size(spark):
    """Whether a group has more than two rows is known of each of its rows, wherever batches end."""
    from tidemark.llm.ngram_join import POSTING, grouped_postings

    rng = random.Random(9)
    rows = [(t, s, salts, d, 10, d % 3) for t in range(60) for salts in [rng.choice([1, 1, 2])] for s in range(salts) for d in sorted(rng.sample(range(100), rng.randint(1, 6)))]
    of = {}
    for t, s, _, d, _, _ in rows:
        of.setdefault((t, s), []).append(d)
    want = sorted((*row, min(of[row[:2]]), 10, min(of[row[:2]]) % 3, len(of[row[:2]]) > 2) for row in rows if len(of[row[:2]]) > 1 or row[2] > 1)
    posted = spark.createDataFrame(rng.sample(rows, len(rows)), POSTING)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (1, 2, 3, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert sorted(tuple(r) for r in grouped_postings(posted).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_groups_that_allow_no_pair_beside_the_pivot_are_not_placed(spark, monkeypatch):
    """Three texts of unlike sizes share a passage: after the pivot's pairs no other can be linked, so no round joins their postings."""
    from tidemark.llm import ngram_join

    rng = random.Random(8)
    passage = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    common = [passage(20) for _ in range(40)]
    texts = []
    for _ in range(40):
        own = passage(40)
        texts += [" ".join([*own, *(w for part in rng.sample(common, size) for w in part)]) for size in (2, 5, 11)]
    docs = list(enumerate(texts)) + [(1000 + d, t) for d, t in near_copies(4, groups=3, copies=8)]
    placed, place = [], ngram_join._placed

    def seen(*args):
        out = place(*args)
        placed.append({frozenset(r.docs) for r in out.groupBy("token").agg(F.collect_set("doc_id").alias("docs")).collect()})
        return out

    monkeypatch.setattr(ngram_join, "_placed", seen)
    assert run(spark, docs)[1] == brute(docs)
    assert placed[0] and not any(frozenset(range(d, d + 3)) in groups for groups in placed for d in range(0, 120, 3))


def test_groups_keep_every_pair_beside_the_pivot(spark):
    """A group stays whole if any two rows, of which none is the pivot's, pass both filters; it leaves if no two are near enough in size."""
    from tidemark.llm.ngram_join import POSTING, with_pairs_left

    rng = random.Random(10)
    rows = []
    for token in range(600):
        base = rng.randint(4, 120)
        for d in sorted(rng.choices(range(50), k=rng.randint(3, 6))):  # an id may come with two texts
            n = max(1, round(base * rng.choice([0.3, 0.5, 0.7, 0.8, 1, 1, 1.3, 2])))
            rows.append((token, 0, 1, d, n, rng.randrange(prefix_length(n))))
    of = {}
    for row in rows:
        of.setdefault(row[0], []).append(row)
    pivots = {t: group[0][3:] for t, group in of.items()}
    df = spark.createDataFrame([(*row, *pivots[row[0]], True) for row in rng.sample(rows, len(rows))], f"{POSTING}, pivot bigint, pivot_n int, pivot_pos int, wide boolean")
    got = with_pairs_left(df)
    kept = {}
    for r in got.collect():
        kept.setdefault(r.token, []).append(tuple(r)[:6])
    assert got.columns == df.columns
    for t, group in of.items():
        rest = [row for row in group if row[3:] != pivots[t]]
        near = [(x, y) for i, x in enumerate(rest) for y in rest[:i] if 4 * min(x[4], y[4]) >= 3 * max(x[4], y[4])]
        if any(min(x[4] - x[5], y[4] - y[5]) >= least_overlap(x[4], y[4]) for x, y in near):
            assert t in kept
        assert t not in kept or (near and sorted(kept[t]) == sorted(group))
    assert 100 < len(kept) < 500


def test_rows_of_a_salted_n_gram_stay_dealt_when_open_groups_are_kept(spark):
    """Whether a token is open is known of all its salts, and its rows are joined by token and salt: no task gets all of them."""
    from tidemark.llm.ngram_join import _still_open

    rows = [(t, d % salts, salts, d, 10, 0, 7 if t % 2 == 0 or d != 4 else d, 7) for t, salts in ((1, 1), (2, 1), (3, 5), (4, 5)) for d in range(40)]
    placed = spark.createDataFrame(rows, "token bigint, salt int, salts int, doc_id bigint, n int, pos int, component bigint, pivot_component bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = _still_open(placed)
        assert sorted(tuple(r) for r in out.select(*placed.columns).collect()) == sorted(row for row in rows if row[0] % 2)
        on = re.search(r"SortMergeJoin \[([^\]]*)\], \[[^\]]*\], LeftSemi", out._jdf.queryExecution().executedPlan().toString())[1]
        assert re.findall(r"[a-z]+(?=#)", on) == ["token", "salt"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
