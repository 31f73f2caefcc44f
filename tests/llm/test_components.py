import random

import pytest

from tidemark.llm.components import connected_components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(2, 1), (1, 2), (2, 3)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(random.Random(k).randrange(80), random.Random(k + 999).randrange(80)) for k in range(60)]])
def test_against_union_find(spark, links):
    rows = connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r.node: r.component for r in rows} == brute(links) and len(rows) == len(brute(links))
