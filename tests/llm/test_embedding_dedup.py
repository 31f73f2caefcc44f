import math

import numpy as np
import pytest

from tidemark.llm.embedding_dedup import near_vectors, stars


def brute(rows):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float) / max(map(abs, v))
        return a / np.linalg.norm(a)

    units = {i: (unit(v) if label is not None else None, label) for i, v, label in rows}
    parent = {i: i for i in units}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(units, 0)
    for i, (a, x) in units.items():
        for j, (b, y) in units.items():
            if i != j and a is not None and b is not None and x == y and len(a) == len(b) and a @ b >= 0.98:
                links[i] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (links[i], find(i), find(i) == i) for i in units}


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            noise = rng.choice([0.0, 0.01, 0.08, 0.12])
            rows.append([float(np.float32(x)) for x in base + noise * rng.normal(size=24)] if noise else [float(np.float32(x)) for x in base])
    rows = [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    odd = [None, [0.0] * 24, [-0.0] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0, 2.0], [1.0, 2.0], [1e-40] * 3, [1e-40] * 3]
    rows += [(5000 + k, v, 0) for k, v in enumerate(odd)]
    return rows + [(6000, rows[0][1], None), (6001, rows[0][1], None), (6002, [0.0, 1.0], 0), (6003, [-0.0, 1.0], 0), (6004, [0.0, 5.0], 0)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, kept int").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, **options).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_borders_of_ranges_part_no_neighbours(spark):
    """As many ranges as there are few rows in each: what a border parts is found in the second step."""
    rows = corpus()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_stars():
    rng = np.random.default_rng(2)
    for _ in range(20):
        u, v = rng.integers(0, 40, (2, 30))
        a, b = stars(u, v)
        parent = list(range(40))
        for x, y in zip(u, v, strict=True):
            x, y = parent[x], parent[y]
            parent = [min(x, y) if p in (x, y) else p for p in parent]
        assert dict(zip(b.tolist(), a.tolist(), strict=True)) == {k: p for k, p in enumerate(parent) if p != k}


@pytest.mark.parametrize("mutual", [0.0, 0.8, 0.9])
def test_recall_in_crowded_labels(spark, mutual):
    """3,000 vectors of one label whose cosines lie about ``mutual``, and 600 near copies at 0.981."""
    rng = np.random.default_rng(7)
    centre = np.zeros(64)
    centre[0] = 1

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    loose = unit(rng.normal(size=(3000, 64)) * (np.arange(64) > 0))
    x = np.sqrt(mutual) * centre + np.sqrt(1 - mutual) * loose
    away = rng.normal(size=(600, 64))
    away = unit(away - (away * x[:600]).sum(1, keepdims=True) * x[:600])
    near = 0.981 * x[:600] + np.sqrt(1 - 0.981**2) * away
    every = np.concatenate([x, near])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(every)]
    got = run(spark, rows)
    want = (every @ every.T >= 0.98).sum(1) - 1
    queries = [k for k in range(len(every)) if k % 20 == 0]
    assert all(got[k][0] <= want[k] for k in range(len(every)))
    assert sum(got[k][0] for k in queries) >= 0.9 * sum(want[k] for k in queries) and sum(want) >= 1200
    assert sum(got[k][0] for k in range(len(every))) >= 0.95 * sum(want)


def test_edges(spark):
    assert run(spark, []) == {}
    rows = near_vectors(spark.createDataFrame([(None, [1.0], 0), (1, [1.0], 0), (1, [1.0], 0), (2, [3.0], 0)], "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in rows) == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("None", 0, "None", False)]


def test_many_copies_are_not_paired(spark):
    rows = [(k, [1.0, 2.0, 3.0], 0) for k in range(3000)] + [(4000, [1.0, 2.0, 3.01], 0)]
    got = run(spark, rows)
    assert got[0] == (3000, 0, True) and got[4000] == (3000, 0, False)


def test_links_of_a_cluster_far_wider_than_the_window(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(k, [float(x) for x in base + 0.11 * rng.normal(size=16)], 1) for k in range(150)]
    want = brute(rows)
    got = run(spark, rows, window=4, block_rows=40)
    assert max(n for n, _, _ in want.values()) > 60 and got == want
