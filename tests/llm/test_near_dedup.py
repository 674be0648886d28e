from __future__ import annotations

import random

import numpy as np
import pytest

from brindle.llm import near_dedup as nd
from brindle.llm.components import components
from tests.llm.cases import clashing, odd_docs, odd_rows, sentence, words


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width):
    """(id, set size, component id) of each row, by all pairs."""
    sets = [shingles(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def found(docs, width):
    return sorted(((r.row_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, width).collect()), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_odd_cases(spark, width):
    assert found(clashing(odd_docs(spark)), width) == brute(odd_rows(), width)


def test_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_WEIGHT", 30_000)
    rng = random.Random(9)
    base, rows = sentence(rng, 120).split(), []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(60)}"
        rows.append((rng.randrange(10**6), " ".join(own), "en", "s", 0))
    rows += [(10**7 + i, sentence(rng, 50) + " " + " ".join(base[:60]), "en", "s", 0) for i in range(20)]
    assert found(spark.createDataFrame(rows, odd_docs(spark).schema), 4) == brute(rows, 4)


def test_keep_one_leaves_one_of_each_group(spark):
    rows = odd_rows()
    kept = nd.keep_one(odd_docs(spark)).collect()
    comps = {c for _, n, c in brute(rows, 5) if n}
    assert len([r for r in kept if words(r.text)]) == len(comps)
    assert len([r for r in kept if not words(r.text)]) == len([r for r in rows if not words(r[1])])
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_table(spark):
    assert nd.near_duplicates(odd_docs(spark).limit(0)).count() == 0
    assert nd.keep_one(odd_docs(spark).limit(0)).count() == 0


def test_block_links_are_exact():
    rng = np.random.default_rng(4)
    make = lambda: np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64))
    ring, members = [make() for _ in range(30)], [make() for _ in range(25)]
    got = nd.block_links(ring, members)
    for a, hits in zip(ring, got, strict=True):
        want = [j for j, b in enumerate(members) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
        assert hits.tolist() == want


def test_components(spark):
    rng = random.Random(2)
    links = [(f"{a:05d}".encode(), f"{b:05d}".encode()) for a, b in [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]]
    got = {bytes(r.vertex): bytes(r.root) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    parent = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}


def test_query_matches_brute_force(spark, sf):
    from brindle.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_near_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
