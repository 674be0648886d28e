from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import substring_dedup as sd
from tests.llm.cases import clashing, odd_docs, odd_rows, sentence, words


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(60):
        borders = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 4))])
        v = rng.integers(0, 1 << (3 if trial % 3 == 0 else 39), borders[-1], dtype=np.uint64) << np.uint64(24)
        span = int(rng.integers(1, 9))
        want = set()
        for t in range(4):
            for c in range(borders[t], borders[t + 1]):
                left, right = c, c
                while left - 1 >= borders[t] and v[left - 1] > v[c]:
                    left -= 1
                while right + 1 < borders[t + 1] and v[right + 1] >= v[c]:
                    right += 1
                if right - left + 1 >= span:
                    want.add((left, c, right))
        got = sd.compact_windows(v, borders, span)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def check(rows, found):
    """No run of 50 words that stands in two documents is left out; what is reported is 80% alike."""
    docs = [(r[0], words(r[1])) for r in rows]
    runs = defaultdict(set)
    for n, (_, w) in enumerate(docs):
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add((n, i))
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.start_word, r.end_word))
    for places in runs.values():
        if len({n for n, _ in places}) > 1:
            for n, i in places:
                assert any(a <= i and i + 50 <= b for a, b in spans[docs[n][0]]), (docs[n][0], i)
    by_id = defaultdict(list)
    for k, w in docs:
        by_id[k].append(w)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in found:
        n = r.end_word - r.start_word
        alike = [(a, b) for x in by_id[r.doc_id] for y in by_id[r.partner_id] for a, b in [(grams(x[r.start_word : r.end_word]), grams(y[r.partner_start : r.partner_start + n]))] if len(a & b) >= 0.8 * len(a | b)]
        assert n >= 50 and alike


def test_odd_cases(spark):
    found = sd.repeated_passages(clashing(odd_docs(spark))).collect()
    check(odd_rows(), found)
    ids = {r.doc_id for r in found}
    assert {6, 7, 8, 9, 10, 11, 12, 13, 14, -7} <= ids and not {0, 1, 2, 3, 4, 5, 16, 18} & ids


def test_common_lines_do_not_hide_longer_repeats(spark):
    rng = random.Random(8)
    line, passage, other = sentence(rng, 44), sentence(rng, 70), sentence(rng, 55)
    texts = [sentence(rng, 60) + " " + line + " " + sentence(rng, 60) for _ in range(25)]
    texts += [sentence(rng, 30) + " " + line + " " + passage + " " + sentence(rng, 90) for _ in range(4)]
    texts += [other + " " + sentence(rng, 70), sentence(rng, 80) + " " + other, sentence(rng, 200)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    found = sd.repeated_passages(spark.createDataFrame(rows, odd_docs(spark).schema)).collect()
    check(rows, found)
    assert {r.doc_id for r in found} == {25, 26, 27, 28, 29, 30}


def test_near_copies_that_are_unlike_the_first_text_of_their_list(spark):
    rng = random.Random(22)
    texts, near = [], []
    for _ in range(6):
        passage = sentence(rng, 60).split()
        x = [w if i not in (13, 46) else f"changed{i}" for i, w in enumerate(passage)]
        y = [w if i != 29 else "middle" for i, w in enumerate(x)]
        texts += [sentence(rng, 40) + " " + " ".join(passage) + " " + sentence(rng, 40) for _ in range(8)]
        near += [len(texts), len(texts) + 1]
        texts += [sentence(rng, 40) + " " + " ".join(w) + " " + sentence(rng, 40) for w in (x, y)]
    found = sd.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check(list(enumerate(texts)), found)
    hit = {(r.doc_id, r.partner_id) for r in found}
    assert sum((a, b) in hit or (b, a) in hit for a, b in zip(near[::2], near[1::2], strict=True)) >= 5


def test_repeats_within_the_first_text_of_a_list(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(8):
        passage = sentence(rng, 56).split()
        quote, whole = " ".join(passage[5:51]), " ".join(passage)
        texts += [" ".join([sentence(rng, 60), quote, sentence(rng, 60), whole, sentence(rng, 60), whole]), sentence(rng, 50) + " " + whole + " " + sentence(rng, 50)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    check(rows, sd.repeated_passages(spark.createDataFrame(rows, odd_docs(spark).schema)).collect())


def test_runs_of_one_word(spark):
    rng = random.Random(12)
    runs = [("the " * n).split() for n in (49, 60, 90, 300)]
    texts = [" ".join(sentence(rng, 20).split() + r + sentence(rng, rng.randint(5, 70)).split()) for r in runs for _ in range(3)]
    texts += [" ".join(sentence(rng, 30).split() + runs[1] + texts[0].split()[-5:]), " ".join(runs[3] + sentence(rng, 9).split())]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    check(rows, sd.repeated_passages(spark.createDataFrame(rows, odd_docs(spark).schema)).collect())


def test_substitutions_within_bounds_are_found(spark):
    rng = random.Random(10)
    passage = sentence(rng, 120).split()
    changed = list(passage)
    changed[55] = "other"
    far = [w if i % 6 else "gone" for i, w in enumerate(passage)]
    texts = [" ".join([sentence(rng, 40), " ".join(p), sentence(rng, 40)]) for p in (passage, changed, far)]
    found = sd.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in found} == {(0, 40, 160), (1, 40, 160)}


def test_empty_table_and_query(spark, sf):
    from brindle.llm.queries import QUERIES

    assert sd.repeated_passages(odd_docs(spark).limit(0)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op5_substring_dedup"](spark, sf).collect())


def test_texts_of_32_mb_and_more():
    passage = sentence(random.Random(9), 80)
    long = " ".join(map(str, np.random.default_rng(9).integers(10**8, 10**9, 3_400_000).tolist())) + " " + passage
    assert len(long) >= 1 << 25
    batch = pa.RecordBatch.from_pydict({"text_key": [1, 2], "text": [long.encode(), passage.encode()]})
    key, text, _ = (c.to_numpy() for c in pa.Table.from_batches(sd._posts([batch])).columns)
    both = np.intersect1d(key[text == 1], key[text == 2])
    assert len(both) >= sd.HASHES
    batch = pa.RecordBatch.from_pydict({"text_key": [1, 2], "keys": [both.tolist()] * 2, "text": [long.encode(), passage.encode()]})
    entries = pa.Table.from_batches(sd._anchors([batch])).sort_by([("key", "ascending"), ("text_key", "ascending"), ("c", "ascending")])
    met = pa.Table.from_batches(sd._compared(entries.combine_chunks().to_batches()[:1])).sort_by([(c, "ascending") for c in ("p", "x", "shift", "low")])
    found = pa.Table.from_batches(sd._merged(met.combine_chunks().to_batches()))
    assert (1, 2, 3_400_000, 3_400_080, 0, 80) in set(zip(*(c.to_pylist() for c in found.columns), strict=True))


@pytest.mark.parametrize("gap,want", [(0, 1), (4, 1), (40, 2)])
def test_passages_join_over_small_gaps(gap, want):
    found = [(0, 0, 100 - (sd.WIDTH - 1 if gap else 0)), (0, 100 + gap, 196 + gap)]
    assert len(sd.passages(found)) == want


def test_star_ties_all_texts_of_a_bucket():
    rng = np.random.default_rng(3)
    text = np.sort(rng.integers(0, 12, 200))
    bucket = rng.integers(0, 9, 200).astype(np.uint64)
    row, partner = sd.star(bucket, text)
    assert (bucket[row] == bucket[partner]).all() and (text[row] != text[partner]).all()
    for b in range(9):
        here = np.flatnonzero(bucket == b)
        assert set(here) == set(row[bucket[row] == b]) or len(set(text[here])) == 1
    assert not len(sd.star(np.zeros(5, np.uint64), np.ones(5))[0])


def fragments(seed: int) -> list[tuple[int, str]]:
    """Pieces of 41 to 56 words of four common passages of 110 words, in texts of their own."""
    rng = random.Random(seed)
    common = [sentence(rng, 110).split() for _ in range(4)]
    out = []
    for i in range(200):
        n = rng.randint(41, 56)
        at = rng.randint(0, 110 - n)
        out.append((i, " ".join([sentence(rng, rng.randint(0, 30)), *rng.choice(common)[at : at + n], sentence(rng, rng.randint(0, 30))])))
    return out


@pytest.mark.parametrize("seed,most", [(1, None), (2, None), (2, 20)])
def test_overlapping_fragments_and_long_lists(spark, monkeypatch, seed, most):
    rows = fragments(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sd.repeated_passages(docs).collect()
    check(rows, found)
    if most:
        monkeypatch.setattr(sd, "LIST", most)
        pieces = sd.repeated_passages(docs.repartition(7)).collect()
        assert sorted(pieces) == sorted(found)


def test_near_copies_by_brute_force(spark):
    """Of all pairs of texts that hold 60-word passages 80% alike, what share has both passages reported?"""
    rng = random.Random(31)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, held = [], []
    for _ in range(30):
        base = sentence(rng, 60).split()
        for k in range(6):
            w = list(base)
            for at in rng.sample(range(5, 55), k % 3):
                if rng.random() < 0.4:
                    w.insert(at, sentence(rng, 1))
                else:
                    w[at] = sentence(rng, 1)
            before = sentence(rng, rng.randint(20, 60))
            held.append((len(before.split()), w))
            texts.append(" ".join([before, *w, sentence(rng, rng.randint(20, 60))]))
    found = sd.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = defaultdict(set)
    for r in found:
        at, w = held[r.doc_id]
        if r.start_word < at + len(w) and at < r.end_word:
            classes[r.doc_id].add(r.passage_class)
    alike = [(a, b) for a in range(len(texts)) for b in range(a) for x, y in [(grams(held[a][1]), grams(held[b][1]))] if a // 6 == b // 6 and len(x & y) >= 0.8 * len(x | y)]
    caught = sum(bool(classes[a] & classes[b]) for a, b in alike)
    assert len(alike) > 100 and caught >= 0.97 * len(alike), (caught, len(alike))


def test_classes_and_an_inserted_word(spark):
    rng = random.Random(41)
    passage = sentence(rng, 70).split()
    texts = [sentence(rng, 30 + i) + " " + " ".join(passage) + " " + sentence(rng, 30) for i in range(9)]
    more = " ".join([*passage[:35], "inserted", *passage[35:]])
    texts += [sentence(rng, 20) + " " + more, texts[0], sentence(rng, 300)]
    rows = list(enumerate(texts))
    found = [r for r in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.end_word - r.start_word < 90]
    assert {r.doc_id for r in found} == set(range(11)) and len({r.passage_class for r in found}) == 1
    assert {r.class_documents for r in found} == {11}
    assert {(r.start_word, r.end_word) for r in found if r.doc_id == 9} == {(20, 91)}
