from __future__ import annotations

import random

from brindle.llm.components import components


def test_chains_stars_and_loops_by_brute_force(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(900, 900), (100, 100), (3, 2), (2, 3), (2, 3)]
    links += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(70)]
    parent = {v: v for link in links for v in link}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(parent.items())


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0
