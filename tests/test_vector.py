from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import bow
from brindle.operators.vector import IVFIndex, graph_top_k, kmeans, random_vectors, recall_at_k, top_k, top_k_batch


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 8))
    rows = centres[rng.integers(0, 10, 400)] + 0.15 * rng.normal(size=(400, 8))
    return rows.astype(np.float32), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, v array<float>").cache()


def best(rows, q, k, metric):
    rows, q = rows.astype(float), np.array(q, float)
    if metric == "euclidean":
        s = 1 / (1 + np.linalg.norm(rows - q, axis=1))
    elif metric == "cosine":
        s = rows @ q / (np.linalg.norm(rows, axis=1) * np.linalg.norm(q))
    else:
        s = rows @ q
    return np.lexsort((np.arange(len(s)), -s))[:k].tolist()


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "inner_product"])
def test_exact(blobs, spark, metric):
    rows, df = blobs
    q = rows[7].tolist()
    assert [r.id for r in top_k(df, q, 10, "id", "v", metric).collect()] == best(rows, q, 10, metric)
    assert [r.id for r in graph_top_k(df, q, 10, "id", "v", metric).collect()] == best(rows, q, 10, metric)
    queries = spark.createDataFrame([(k, rows[k].tolist()) for k in range(7)], "q long, qv array<float>")
    got = top_k_batch(df, queries, 4, "id", "v", "q", "qv", metric, block=3).collect()
    assert {(r.query_id, r["rank"]): r.id for r in got} == {(k, i + 1): x for k in range(7) for i, x in enumerate(best(rows, rows[k], 4, metric))}


def test_zero_vector_has_no_cosine(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>")
    assert top_k(df, [1.0, 0.0], 1, "id", "v", "cosine").first().score == 0.0
    with pytest.raises(ValueError):
        top_k(df, [1.0], 1, "id", "v", "other")


def test_ivf_recall_and_upkeep(blobs, spark, tmp_path):
    rows, df = blobs
    index = IVFIndex.build(df, "id", "v", nlist=10)
    full = index.top_k(rows[3].tolist(), 10, nprobe=10)
    assert [r.id for r in full.collect()] == best(rows, rows[3], 10, "euclidean")
    saved = index.save(str(tmp_path / "ivf"))
    found = saved.top_k(rows[3].tolist(), 10, nprobe=3).selectExpr("0L as q", "id")
    exact = top_k(df, rows[3].tolist(), 10, "id", "v").selectExpr("0L as q", "id")
    assert recall_at_k(found, exact, 10, "q", "id").first().recall >= 0.8
    changed = saved.insert(spark.createDataFrame([(999, rows[3].tolist())], "id long, v array<float>"), "id", "v").remove(spark.createDataFrame([(3,)], "id long"), "id")
    assert changed.top_k(rows[3].tolist(), 1).first().id == 999


def test_kmeans_is_repeatable(blobs):
    a, b = (kmeans(blobs[0].astype(float), 5, seed=2) for _ in range(2))
    assert (a == b).all() and a.shape == (5, 8)
    assert len(kmeans(np.ones((3, 2)), 8)) == 3


def test_random_vectors(spark):
    a, b = (random_vectors(spark, 20, 4, seed=1).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert a == b and all(-1 <= x < 1 for r in a for x in r.vector)


def test_bag_of_words(spark):
    code = [[0.0, 0.0], [10.0, 0.0], [20.0, 0.0]]
    d = spark.createDataFrame([("a", [0.1, 0.0]), ("a", [0.2, 0.0]), ("a", [11.0, 0.0]), ("b", [19.0, 0.0])], "id string, v array<double>")
    counts = bow.histograms(d, "id", "v", code)
    assert {(r.id, r.word): r["count"] for r in counts.collect()} == {("a", 0): 2, ("a", 1): 1, ("b", 2): 1}
    vectors = bow.dense(bow.tfidf_vectors(counts, bow.smoothed_idf(counts, "id"), "id"), "id", 3)
    got = {r.id: r.vector for r in vectors.collect()}
    assert got["b"] == [0.0, 0.0, 1.0] and np.linalg.norm(got["a"]) == pytest.approx(1) and got["a"][0] == pytest.approx(2 * got["a"][1])


def test_ivf_probes_enough_lists(spark):
    df = random_vectors(spark, 2000, 16, seed=4).select("id", F.col("vector").alias("v")).cache()
    rows = np.array([r[0] for r in df.orderBy("id").select("v").collect()], float)
    index = IVFIndex.build(df, "id", "v")
    owner = {r[0]: r[1] for r in index.lists.select("key", "list_id").collect()}
    nprobe = index.enough(10)
    hits = []
    for q in range(0, 2000, 20):
        exact = np.lexsort((np.arange(2000), ((rows - rows[q]) ** 2).sum(1)))[:10]
        probed = set(index.probes(rows[q].tolist(), "euclidean", nprobe))
        hits.append(np.mean([owner[int(i)] in probed for i in exact]))
    assert np.mean(hits) >= 0.9 and nprobe > 8
    assert index.top_k(rows[20].tolist(), 10).count() == 10


def test_keys_of_any_type_and_missing_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0]), ("d", [1.0, None]), ("e", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "qid string, qv array<double>")
    got = top_k_batch(df, asked, 2, "id", "v", "qid", "qv")
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in got.orderBy("rank").collect()] == [("q", "a", 1.0, 1), ("q", "e", 1.0, 2)]
    assert [r.id for r in top_k(df, [1.0, 0.0], 9, "id", "v").collect()] == ["a", "e", "c"]
    index = IVFIndex.build(df, "id", "v", nlist=2)
    assert [r.id for r in index.top_k([1.0, 0.0], 9, nprobe=2).collect()] == ["a", "e", "c"]
    assert len(index.recalls(1)) == 2
    assert top_k_batch(df, asked.filter("qid = 'none'"), 2, "id", "v", "qid", "qv").count() == 0
    assert top_k_batch(df.filter("id = 'x'"), asked, 2, "id", "v", "qid", "qv").count() == 0
