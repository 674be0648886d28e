from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import spatial as sf
from brindle.operators import spatial


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(600)] + [(600, None, 1.0)], "id long, x double, y double").cache()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_known_distance(spark):
    d = sf.distance(-56.1645, -34.9011, -58.3816, -34.6037, "haversine")
    assert one(spark, d) == pytest.approx(205_232.35938356873, rel=1e-9)
    assert one(spark, sf.distance(0.0, 0.0, 3.0, 4.0)) == 5.0


@pytest.mark.parametrize("metric,radius", [("euclidean", 0.0), ("euclidean", 60.0), ("haversine", 3e6), ("haversine", 1.9e7)])
@pytest.mark.parametrize("centre", [(0.0, 0.0), (179.0, 85.0), (-170.0, -40.0)])
def test_box_does_not_lose_points(cloud, metric, radius, centre):
    d = sf.distance(F.col("x"), F.col("y"), *centre, metric, sf.LIBRARY_RADIUS)
    every = {r.id for r in cloud.filter(d <= radius).collect()}
    assert {r.id for r in spatial.radius_search(cloud, *centre, radius, metric).collect()} == every


def test_knn_orders_by_distance_then_place(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 1.0), (4, 5.0, 5.0), (5, None, 0.0)], "id long, x double, y double")
    assert [r.id for r in spatial.knn(df, 0.0, 0.0, 3, "id").collect()] == [2, 3, 1]
    assert spatial.knn(df, 0.0, 0.0, 9, "id").count() == 4


def test_polygon_rules(spark):
    square = sf.Polygon(((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))
    assert len(square.corners) == 4
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 0.0, 0.0), (4, 3.0, 1.0), (5, -1.0, 2.0)], "id long, x double, y double")
    inside = lambda b: {r.id for r in spatial.polygon_search(df, square, b).collect()}
    assert inside(True) == {1, 2, 3} and inside(False) == {1}
    for bad in [((0, 0), (1, 1)), ((0, 0), (1, 1), (2, 2)), ((0, 0), (2, 2), (2, 0), (0, 2)), ((0, 0), (0, 0), (1, 1))]:
        with pytest.raises(ValueError):
            sf.Polygon(bad)


def test_within_join_equals_all_pairs(cloud):
    p = cloud.filter("x is not null")
    rows = [(r.id, r.x, r.y) for r in p.collect()]
    want = {(a, b) for a, ax, ay in rows for b, bx, by in rows if math.hypot(ax - bx, ay - by) <= 12.0}
    got = spatial.within_join(p, p, 12.0, "id", "id").collect()
    assert {(r.left_key, r.right_key) for r in got} == want and len(got) == len(want)


def crowded_rows():
    rng = random.Random(9)
    places = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(40)] + [(0.0, 0.0), (-1e-16, 0.0), (9.0, 0.0), (-0.0, 0.0), (1e300, 0.0), (1e300, 5.0), (-1e300, 0.0)]
    rows = [(i, *rng.choice(places)) for i in range(500)] + [(1000 + i, 3.0, 4.0) for i in range(60)]
    rows += [(2000 + i, *p) for i, p in enumerate([*places, (None, 0.0), (0.0, None), (math.nan, 0.0), (math.inf, 0.0), (math.inf, 0.0), (-math.inf, 1.0)])]
    return rows + [(7, 3.0, 4.0), (7, 3.0, 4.0), (None, 3.0, 4.0)]


@pytest.mark.parametrize("pack,crowd", [(1024, 16_384), (4, 20)])
def test_within_join_of_copies_equals_all_pairs(spark, monkeypatch, pack, crowd):
    monkeypatch.setattr(spatial, "PACK", pack)
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rows = crowded_rows()
    p = spark.createDataFrame(rows, "id long, x double, y double")
    some = [r for r in rows if None not in r[1:]]
    want = sorted(((a, b) for a, ax, ay in some for b, bx, by in some if math.hypot(ax - bx, ay - by) <= 9.0), key=repr)
    got = spatial.within_join(p, p, 9.0, "id", "id", digits=3).collect()
    assert sorted(((r.left_key, r.right_key) for r in got), key=repr) == want
    at = {r[0]: r[1:] for r in rows}
    assert all(r.distance == pytest.approx(math.hypot(at[r.left_key][0] - at[r.right_key][0], at[r.left_key][1] - at[r.right_key][1]), abs=6e-4) for r in got if 7 not in tuple(r))
    pairs = spatial.within_pairs(p, 9.0, "id", digits=3).collect()
    ascending = lambda found: sorted(tuple(r) for r in found if r.left_key is not None and r.right_key is not None and r.left_key < r.right_key)
    assert ascending(pairs) == ascending(got) and len(pairs) == len(ascending(got))


def test_places_of_copies_are_compared_once(spark):
    p = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert spatial._near_places(p, p, 1.0, "id", "id", F.lit(True), None).count() == 7
    assert spatial.within_pairs(p, 1.0, "id").count() == 3 * 1000 * 999 // 2 + 2 * 1000 * 1000


def test_validation():
    for bad in [(200.0, 0.0), (0.0, 91.0), (math.nan, 0.0)]:
        with pytest.raises(ValueError):
            sf.check_point(*bad, "haversine")
    with pytest.raises(ValueError):
        sf.check_radius(-1)
    with pytest.raises(ValueError):
        sf.metric_name("manhattan")
    assert sf.metric_name(" Haversine ") == "haversine"


def test_batch_of_neighbours_equals_single_searches(spark):
    points = spatial.random_points(spark, 300, seed=5).union(spark.createDataFrame([(900, None, 1.0), (901, -77.0, -12.0), (902, -77.0, -12.0)], "id long, x double, y double"))
    asked = spark.createDataFrame([("a", -77.0, -12.0), ("b", -76.95, -11.92), ("c", None, 1.0)], "query_id string, qx double, qy double")
    for metric in ("euclidean", "haversine"):
        got = spatial.knn_batch(points, asked, 5, "id", metric, block=1)
        for q, x, y in [("a", -77.0, -12.0), ("b", -76.95, -11.92)]:
            one = [(r.id, round(r.distance, 6)) for r in spatial.knn(points, x, y, 5, "id", metric).collect()]
            assert [(r.id, round(r.distance, 6)) for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == one
        assert got.filter("query_id = 'c'").count() == 0
