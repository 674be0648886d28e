from __future__ import annotations

import math

import pytest

from brindle.functions.analyzer import analyze, analyzer, stem
from brindle.operators.text import TextIndex, nested_sample, precision_recall, query_length_variants, scan_bm25


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "alpha alpha common"), (2, "beta common"), (3, ""), (4, None)], "id int, text string")


@pytest.mark.parametrize(
    "word,want",
    [("canciones", "canción"), ("luces", "luz"), ("ponies", "pony"), ("indexes", "index"), ("boxes", "boxe"), ("tables", "tabl"), ("cats", "cats"), ("virus", "virus"), ("class", "class"), ("rapidamente", "rapida"), ("running", "run"), ("falling", "fall"), ("sing", "sing"), ("played", "play"), ("abc", "abc"), ("a1b2s", "a1b2s"), ("quickly", "quick"), ("darkness", "dark")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_analyzer(spark):
    text = "The ﬁrst Straße, of_running!"
    assert analyze(text) == ["first", "strasse", "run"]
    assert analyze(text, (), False) == ["the", "first", "strasse", "of", "running"]
    assert analyze(None) == []
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(analyzer()(df.t)).collect()] == [["first", "strasse", "run"], []]


def test_bm25_formula(docs):
    index = TextIndex.build(docs, "id", "text")
    (row,) = index.match_top_k("alpha", 5).collect()
    n, df, tf, length, avg = 3, 1, 2, 3, 5 / 3
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert row.id == 1 and row.score == pytest.approx(want)
    assert [(r.id, r.score > 0) for r in index.top_k("alpha", 5).collect()] == [(1, True), (2, False), (3, False)]
    assert index.match_top_k("zzz", 5).count() == 0
    with pytest.raises(ValueError):
        index.bm25("alpha", k1=0)


def test_scan_equals_index(docs, spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r.score for r in TextIndex.build(d, "doc_id", "text").bm25("the tion tion").collect()}
    b = {r.doc_id: r.score for r in scan_bm25(d, "doc_id", "text", "the tion tion").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_tf_idf_is_a_cosine(docs):
    index = TextIndex.build(docs, "id", "text")
    got = {r.id: r.score for r in index.tf_idf("alpha common").collect()}
    a, c = math.log(3), math.log(3 / 2)
    assert got[1] == pytest.approx((2 * a * a + c * c) / (math.hypot(2 * a, c) * math.hypot(a, c)))


def test_saved_index(docs, tmp_path):
    saved = TextIndex.build(docs, "id", "text").save(str(tmp_path))
    assert [r.id for r in saved.match_top_k("common", 5).collect()] == [2, 1]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q int, d int, rank int")
    good = spark.createDataFrame([(1, 10), (1, 12), (3, 9)], "q int, d int")
    got = {r.q: (r.hits, r.precision, r.recall) for r in precision_recall(ranked, good, 2, "q", "d").collect()}
    assert got == {1: (1, 0.5, 0.5), 2: (0, 0.0, None), 3: (0, 0.0, 0.0)}


def test_variants_and_samples(spark):
    q = spark.createDataFrame([(1, "a b c d e f"), (2, "a b")], "id int, text string")
    assert {(r.id, r.variant, r.text) for r in query_length_variants(q, "id", "text").collect()} == {(1, "1", "a"), (1, "3", "a b c"), (1, "5+", "a b c d e f")}
    s = nested_sample(spark.range(100), "id", (5, 20))
    small, large = ({r.id for r in s[n].collect()} for n in (5, 20))
    assert len(large) == 20 and small < large


def test_upkeep_equals_a_new_index(spark, tmp_path):
    before = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, "four")], "id long, t string")
    change = spark.createDataFrame([(2, "two five"), (4, "one")], "id long, t string")
    after = spark.createDataFrame([(1, "one two two"), (2, "two five"), (4, "one")], "id long, t string")
    index = TextIndex.build(before, "id", "t").insert(change, "t").insert(change, "t").remove(before.filter("id = 3"), "id")
    new = TextIndex.build(after, "id", "t")
    saved = new.save(str(tmp_path / "index"))
    assert saved.saved_norms is not None and saved.remove(change, "id").saved_norms is None
    for a, b in ((index.postings, new.postings), (index.lengths, new.lengths), (index.terms, new.terms)):
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    for method in ("bm25", "tf_idf"):
        assert saved.match_top_k("one two", 5, method).collect() == new.match_top_k("one two", 5, method).collect()
        assert saved.insert(change, "t").match_top_k("one two", 5, method).collect() == new.match_top_k("one two", 5, method).collect()
        assert index.match_top_k("one two", 5, method).collect() == new.match_top_k("one two", 5, method).collect()
