from __future__ import annotations

import itertools
import random

import pytest

from brindle.llm import decontam as dc
from tests.llm.cases import clashing, odd_docs, sentence


def test_seeds_meet_every_allowed_run():
    for n in range(dc.SHORTEST, dc.OVERLAP + 1):
        window, errors = dc.allowed(n)
        for wrong in itertools.combinations(range(window), errors):
            assert any(all(at + o not in wrong for o in m) for m in dc.MASKS for at in range(window - m[-1])), (n, wrong)


def items(rng):
    return [(i, sentence(rng, n)) for i, n in enumerate((5, 7, 9, 12, 13, 14, 30, 59))] + [(100, None), (101, ""), (None, sentence(rng, 20))]


def planted(rng, bench):
    docs = []
    for i, text in bench:
        w = (text or "").split()
        for errors in range(4):
            own = list(w)
            for k in rng.sample(range(len(own)), min(errors, len(own))):
                own[k] = "wrong"
            docs.append(sentence(rng, 30) + " " + ", ".join(own).upper() + ". " + sentence(rng, 40))
        docs += [" ".join(w[:13]), " ".join(w[2:]), sentence(rng, 80)]
    return docs


def brute(docs, bench):
    strip = bytes(32 if c in dc.PUNCTUATION else c + 32 if 65 <= c <= 90 else c for c in range(256))
    cut = lambda t: (t or "").encode().translate(strip).split()
    out = set()
    for (d, text), (item, other) in itertools.product(docs, bench):
        a, b = cut(text), cut(other)
        if len(b) < dc.SHORTEST:
            continue
        window, errors = dc.allowed(len(b))
        for start in range(-len(b) + window, len(a) - window + 1):
            same = [0 <= start + k < len(a) and a[start + k] == b[k] for k in range(len(b))]
            lo, hi = max(0, -start), min(len(b), len(a) - start)
            if any(sum(same[k : k + window]) >= window - errors for k in range(lo, hi - window + 1)):
                out.add((d, item))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(6)
    bench = items(rng)
    docs = list(enumerate(planted(rng, bench)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], odd_docs(spark).schema)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    got = dc.overlaps(clashing(df), clashing(b)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 20
    hit = {d for d, _ in want}
    assert {r.doc_id for r in dc.decontaminate(df, b).collect()} == {i for i, _ in docs} - hit


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    bench = items(rng)
    docs = list(enumerate(planted(rng, bench)))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    whole = {tuple(r) for r in dc.overlaps(df, b).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 150)
    assert {tuple(r) for r in dc.overlaps(df, b).collect()} == whole


def test_odd_cases(spark):
    docs = odd_docs(spark)
    text = docs.filter("doc_id = 11").first().text
    bench = spark.createDataFrame([(5, text), (3, text), (8, "one two three")], "item_id long, text string")
    got = dc.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(11, 3), (12, 3), (15, 3)}
    assert dc.decontaminate(docs, bench).count() == docs.count() - 3
    assert dc.overlaps(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert dc.overlaps(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("n,want", [(7, (7, 0)), (9, (9, 1)), (12, (12, 1)), (13, (13, 2)), (50, (13, 2))])
def test_allowed(n, want):
    assert dc.allowed(n) == want


def test_repeated_words_take_linear_work_and_agree_with_brute_force():
    import time

    import numpy as np

    for pattern, n in (("w", 400), ("a b", 60), ("a b c d e f g", 90)):
        text, item = " ".join((pattern.split() * n)[: 3 * n]), " ".join((pattern.split() * n)[:n])
        raw = text.encode()
        (found,) = dc.Benchmark([(1, item)]).find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert found[:2] == (0, 0) and found[4:] == (n, n)
    item, raw = " ".join(["w"] * 400), " ".join(["w"] * 20_000).encode()
    bench, began = dc.Benchmark([(1, item)]), time.time()
    (found,) = bench.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert found[4:] == (400, 400) and time.time() - began < 5


def test_short_items_and_ids_of_text(spark):
    bench = spark.createDataFrame([("a", "three plain words"), ("b", "one two three four five six seven eight"), (None, "x y")], "item_id string, text string")
    docs = spark.createDataFrame([("p", "here are Three plain, words and more"), ("q", "one two three four five six seven eight"), ("r", "x z y")], "doc_id string, text string")
    assert sorted(tuple(r)[:2] for r in dc.overlaps(docs, bench, shortest=3).collect()) == [("p", "a"), ("q", "b")]
    assert sorted(tuple(r)[:2] for r in dc.overlaps(docs, bench).collect()) == [("q", "b")]
    assert [r.doc_id for r in dc.decontaminate(docs, bench, shortest=3).collect()] == ["r"]
