from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import quality, toxicity, words
from tests.llm.cases import clashing, odd_docs, odd_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def check_rules(rows, got):
    want = sorted(((r[0], *rules(r[1])) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


LABELS = "doc_id long, quality int, toxic int"


def junk_corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        text = ". ".join(sentence(rng, rng.randint(5, 12)).capitalize() for _ in range(rng.randint(4, 20)))
        kind = rng.choice(["", "", "", "", "symbols", "shout", "lines"]) if i % 2 else ""
        if kind == "symbols":
            text = text.replace(" ", "*** ")
        elif kind == "shout":
            text = text.upper().replace(" ", "!! ")
        elif kind == "lines":
            text = "\n".join([text[:60], "same old line here", text[60:120]] * 6)
        rows.append((i, text, "en", "s", 0, int(not kind)))
    return rows


def test_rule_statistics(spark):
    extra = [(100 + i, t, "en", "s", 0) for i, t in enumerate(["a a a a a a", "\n\na\na\n a\na", "a\r\nb\r\na\r\n", "x y z w v x y z w v q", "#*$%&|<> é|", "a b c d e\n" * 3])]
    df = spark.createDataFrame(odd_rows() + extra, odd_docs(spark).schema)
    got = quality.quality_rules(clashing(df), spark.createDataFrame([], LABELS)).collect()
    check_rules(odd_rows() + extra, got)
    assert all(r.kept == (not r.base_failed) for r in got)


def test_forest_parts_junk_from_good_on_rows_it_has_not_seen(spark):
    rows = junk_corpus()
    df = spark.createDataFrame([r[:5] for r in rows], odd_docs(spark).schema)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] % 3] + [(None, 1, 1), (5, None, None)], LABELS)
    kept = {r.doc_id: r.kept for r in quality.quality_rules(df, labels).collect()}
    test = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([kept[r[0]] for r in test if r[5]]) >= 0.97
    assert np.mean([not kept[r[0]] for r in test if not r[5]]) >= 0.9
    again = {r.doc_id: r.kept for r in quality.quality_rules(df.repartition(5), labels.repartition(3)).collect()}
    assert kept == again


def test_fit_takes_every_labelled_row(spark):
    made = [r for seed in range(18) for r in junk_corpus(seed)]
    rows, good = [(k, r[1]) for k, r in enumerate(made)], [r[5] for r in made]
    turn = {r[0]: r[1] for r in spark.range(len(rows)).selectExpr("id", "xxhash64(id)").collect()}
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, g, 0) for k, g in enumerate(good)], LABELS)
    data = [t.encode() for _, t in rows]
    s = quality.statistics(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    features = np.column_stack([s[f] for f in quality.FEATURES])
    order = [k for k in sorted(turn, key=turn.get) if s["n_words"][k] >= quality.MIN_WORDS]
    assert len(order) > 16_000
    model = quality.fit_forests(features[order], np.array([good[k] > 0 for k in order]))
    want = np.max([forest.scores(features[:, view]) - bound for view, forest, bound in model], axis=0)
    got = {r.doc_id: r.anomaly for r in quality.quality_rules(df, labels).collect()}
    assert len(got) == len(rows) and max(abs(got[k] - want[k]) for k in got) < 1e-12


def test_thresholds_equal_those_of_sorted_scores(spark):
    rng = np.random.default_rng(4)
    for well, ill in [(4000, 300), (4000, 0), (1, 5), (2500, 2500)]:
        n = len(quality.SCORES)
        scores = np.concatenate([rng.normal(0.4, 0.1, (well, n)), rng.normal(0.55, 0.1, (ill, n))]).round(2 if ill % 500 else 6)
        marks = spark.createDataFrame([(int(i < well), *map(float, r)) for i, r in enumerate(scores)], ["good", *quality.SCORES]).repartition(3)
        assert quality._thresholds(marks) == [quality._threshold(scores[:well, k], scores[well:, k]) for k in range(n)]


def test_isolation_forest_scores():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(size=(500, 2)), [[9.0, 9.0]]])
    scores = quality.IsolationForest(rows, 50, 128, 1).scores(rows)
    assert scores.argmax() == 500 and scores[500] > 0.65
    assert quality.fit_forests(rows, np.zeros(len(rows), bool)) is None
    assert quality.IsolationForest(np.ones((5, 2)), 3, 4, 1).scores(np.ones((2, 2))).shape == (2,)


INSULTS = ["blorgface", "zunthead", "grimplet"]


def toxic_corpus(n=1500):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        w = sentence(rng, rng.randint(20, 150)).split()
        bad = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS).capitalize() + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), "en", "s", 0, int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame([r[:5] for r in rows], odd_docs(spark).schema)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(None, 1, 1), (3, 1, None)], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(clashing(df), labels).collect()}
    for r in rows:
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
        assert got[r[0]].predicted == int(got[r[0]].score >= 0.5) and 0 <= got[r[0]].score <= 1
    test = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].predicted for r in test if r[5]]) >= 0.85
    assert np.mean([got[r[0]].predicted for r in test if not r[5]]) <= 0.01
    flipped = labels.withColumn("toxic", labels.toxic + __import__("pyspark").sql.functions.expr("case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - 2 * toxic else 0 end"))
    assert toxicity.fit_toxicity(df, labels) == toxicity.fit_toxicity(df.repartition(6), flipped)
    kept = {r.doc_id for r in toxicity.drop_toxic(df, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_weights_are_sparse():
    rng = np.random.default_rng(1)
    examples = [(np.unique(np.concatenate([rng.integers(0, 5000, 60), [7777] if i % 5 == 0 else []]).astype(np.int64)), int(i % 5 == 0)) for i in range(1000)]
    used, weights, bias = toxicity.ftrl(examples)
    assert 7777 in used and weights[list(used).index(7777)] == weights.max() and len(used) < 500 and bias < 0


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = odd_docs(spark)
    got = toxicity.toxicity(clashing(docs), labels).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1
    assert toxicity.drop_toxic(docs, labels).count() in (0, docs.count())
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", ["op9_toxicity", "op10_quality"])
def test_queries(spark, sf, name):
    from brindle.llm.queries import QUERIES

    got = QUERIES[name](spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    if name == "op10_quality":
        check_rules(rows, got)


def plain_hash(word: bytes) -> int:
    """The word hash, byte by byte."""
    total, power = 0, 1
    for b in word:
        total += int(toxicity._HASH.value[b]) * power
        power = power * int(words._BASE) % 2**64
    return plain_mix(total % 2**64)


def plain_mix(h: int) -> int:
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def plain_features(text) -> list[int]:
    blank = bytes(32 if c in words.PUNCTUATION + words.SPACES else c for c in range(256))
    h = [plain_hash(w) for w in (text or "").encode().translate(blank).split()]
    keys = set(h)
    for gap, (a, b) in ((1, toxicity._PAIR), (2, toxicity._SKIP)):
        keys |= {plain_mix((x * int(a) + y * int(b)) % 2**64) for x, y in zip(h, h[gap:], strict=False)}
    return sorted({k >> 64 - toxicity.BITS for k in keys})


def plain_ftrl(examples):
    """FTRL-proximal, one coordinate at a time, as published."""
    seen = Counter(k for keys, _ in examples for k in keys)
    z, n = defaultdict(float), defaultdict(float)
    ones = sum(y for _, y in examples)
    heavy = min(3.0, max(1.0, (len(examples) - ones) / max(ones, 1)))

    def weight(k):
        if k == -1:
            return -z[k] / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA) if n[k] else 0.0
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for keys, y in examples:
            keys = [-1, *(k for k in keys if seen[k] >= toxicity.RAREST)]
            w = {k: weight(k) for k in keys}
            g = (1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y) * (heavy if y else 1.0)
            for k in keys:
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return {k: weight(k) for k in list(z) if k == -1 or weight(k)}


def test_op9_by_brute_force(spark, sf):
    from brindle.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    turn = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    marked = [(turn[r.doc_id], plain_features(docs[r.doc_id]), int(r.toxic > 0)) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5]
    weights = plain_ftrl([(keys, y) for _, keys, y in sorted(marked, key=lambda m: m[0])])
    fitted = toxicity.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(fitted) == set(weights) and all(abs(fitted[k] - w) < 1e-9 for k, w in weights.items())
    for r in QUERIES["op9_toxicity"](spark, sf).collect():
        total = weights[-1] + sum(weights.get(k, 0.0) for k in plain_features(docs[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-35, min(35, total))))) < 1e-9
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_forest_scores_by_brute_force():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(300, 3)).round(1)
    forest = quality.IsolationForest(rows, 20, 64, 3)

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def path(tree, row):
        feature, value, child = tree
        node = 0
        while feature[node] >= 0:
            node = child[node] + (row[feature[node]] >= value[node])
        return value[node]

    for row, score in zip(rows, forest.scores(rows), strict=True):
        mean = sum(path(t, row) for t in forest.trees) / 20
        assert abs(score - 2 ** (-mean / expected(64))) < 1e-12
    # a leaf's length is its depth and the expected rest for the rows of the sample that end there
    sample = rows[:64]
    whole = quality.IsolationForest(sample, 5, 64, 4)
    for tree in whole.trees:
        feature, value, child = tree
        stack = [(0, sample, 0)]
        while stack:
            node, part, depth = stack.pop()
            if feature[node] < 0:
                assert abs(value[node] - depth - expected(len(part))) < 1e-12
                assert depth == whole.limit or len(part) <= 1 or (part == part[0]).all()
                continue
            right = part[:, feature[node]] >= value[node]
            stack += [(child[node], part[~right], depth + 1), (child[node] + 1, part[right], depth + 1)]


def test_without_labels_nothing_is_toxic(spark):
    docs = odd_docs(spark)
    assert toxicity.drop_toxic(docs, spark.createDataFrame([], LABELS)).count() == docs.count()
