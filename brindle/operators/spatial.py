"""Spatial queries over DataFrames with point columns x and y."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.spatial import LIBRARY_RADIUS, Polygon, cells, check_point, check_radius, distance, in_box, in_polygon, metric_name, radius_box
from brindle.operators.blocks import BLOCK, nearest_in_blocks

#: Keys of one place that travel as one row, and keys of a grid cell for each task that takes part in it.
PACK, CROWD = 1024, 16_384


def point_search(df: DataFrame, px: float, py: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.filter((F.col(x) == px) & (F.col(y) == py))


def box_search(df: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    return df.filter(in_box(F.col(x), F.col(y), *box))


def radius_search(df: DataFrame, px: float, py: float, radius: float, metric: str = "euclidean", earth: float = LIBRARY_RADIUS, strict: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Rows within the radius (``strict``: nearer than it), with their distance; a bounding box prunes the scan."""
    px, py = check_point(px, py, metric)
    box = radius_box(px, py, check_radius(radius), metric, earth)
    d = distance(F.col(x), F.col(y), px, py, metric, earth)
    near = df.filter(in_box(F.col(x), F.col(y), *box)).withColumn("distance", d)
    return near.filter(F.col("distance") < radius if strict else F.col("distance") <= radius)


def polygon_search(df: DataFrame, polygon: Polygon, boundary: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    return df.filter(in_polygon(F.col(x), F.col(y), polygon, boundary))


def knn(df: DataFrame, px: float, py: float, k: int, key: str, metric: str = "euclidean", earth: float = LIBRARY_RADIUS, x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest rows by (distance, x, y, key): each task keeps its k best, no full sort."""
    px, py = check_point(px, py, metric)
    ranked = df.withColumn("distance", distance(F.col(x), F.col(y), px, py, metric, earth)).filter(F.col("distance").isNotNull())
    return ranked.orderBy("distance", x, y, key).limit(k)


def _distances(metric: str, earth: float):
    def measure(batch: pa.RecordBatch, asked: np.ndarray) -> np.ndarray:
        x, y = (batch.column(i).to_numpy(zero_copy_only=False)[None] for i in (0, 1))
        qx, qy = asked[:, :1], asked[:, 1:2]
        if metric == "euclidean":
            return np.hypot(x - qx, y - qy)
        lat, qlat = np.radians(y), np.radians(qy)
        h = np.sin((qlat - lat) / 2) ** 2 + np.cos(lat) * np.cos(qlat) * np.sin(np.radians(qx - x) / 2) ** 2
        return 2 * earth * np.arcsin(np.sqrt(np.clip(h, 0, 1)))

    return measure


def knn_batch(df: DataFrame, queries: DataFrame, k: int, key: str, metric: str = "euclidean", earth: float = LIBRARY_RADIUS, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of ``df`` for each query (query_id, qx, qy), by (distance, x, y, key).

    Queries are a stated set: they are sent to the tasks in blocks of bounded size, every
    task keeps its k best for each query, and only those are shuffled. Rows without both
    coordinates are near to nothing, and queries without them find nothing.
    """
    rows = df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(key).alias("key")).dropna(subset=["x", "y"])
    found = nearest_in_blocks(rows, 3, queries.select("query_id", "qx", "qy").dropna(subset=["qx", "qy"]), k, _distances(metric_name(metric), earth), block)
    return found.select("query_id", F.col("key").alias(key), "distance", "rank")


def _places(df: DataFrame, key: str, side: float) -> DataFrame:
    """(keys, x, y, part, cx, cy): the keys of one place, at most ``PACK`` a row, and the place's grid cell."""
    finite = (F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf"))  # others, NaN and null too, are near to nothing
    rows = df.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite)
    part = F.floor((F.row_number().over(Window.partitionBy("x", "y").orderBy("key")) - 1) / PACK)
    packed = rows.withColumn("part", part).groupBy("x", "y", "part").agg(F.collect_list(F.struct("key")).alias("keys"))
    cx, cy = cells(F.col("x"), F.col("y"), side)
    return packed.select(F.transform("keys", lambda k: k["key"]).alias("keys"), "x", "y", "part", cx.alias("cx"), cy.alias("cy"))


def _near_places(left: DataFrame, right: DataFrame, radius: float, left_key: str, right_key: str, condition: Column, digits: int | None) -> DataFrame:
    """(left_keys, right_keys, same, distance) of places at most ``radius`` apart for which the condition holds.

    An equi-join on grid cells, each left place in its 9 cells. A cell with many keys is dealt over several tasks:
    its right places go to all of them, and each left place to one. The number of tasks is fixed, since few
    rows here are many pairs, so their bytes say nothing about the work.
    """
    spark = left.sparkSession
    side = check_radius(radius) * (1 + 2**-10) or 1.0  # wider than the radius, so that rounding does not part near places by two cells
    a, b = _places(left, left_key, side), _places(right, right_key, side)
    crowded = F.broadcast(b.groupBy("cx", "cy").agg(F.ceil(F.sum(F.size("keys")) / CROWD).alias("deals")).filter("deals > 1"))  # a row for CROWD keys at most
    step = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    a = a.select(F.col("keys").alias("left_keys"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("part").alias("ap"), "cx", "cy").withColumn("dx", step).withColumn("dy", step)
    a = a.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy").join(crowded, ["cx", "cy"], "left")
    a = a.withColumn("deal", F.pmod(F.xxhash64("ax", "ay", "ap"), F.coalesce("deals", F.lit(1)))).drop("deals")
    b = b.join(crowded, ["cx", "cy"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1)))
    b = b.select(F.col("keys").alias("right_keys"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("part").alias("bp"), "cx", "cy", "deal")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    on = ["cx", "cy", "deal"]
    near = a.repartition(tasks, *on).join(b.repartition(tasks, *on), on).filter(condition)
    near = near.withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).filter(F.col("distance") <= radius)
    same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("ap") == F.col("bp"))
    return near.select("left_keys", "right_keys", same.alias("same"), (F.col("distance") if digits is None else F.round("distance", digits)).alias("distance"))


def within_join(left: DataFrame, right: DataFrame, radius: float, left_key: str, right_key: str, digits: int | None = None) -> DataFrame:
    """Pairs of points at most ``radius`` apart (Euclidean), the distance rounded to ``digits`` if given.

    Distances are taken once for two places; then the pairs of their keys are spelt out.
    """
    near = _near_places(left, right, radius, left_key, right_key, F.lit(True), digits)
    return near.select(F.explode("left_keys").alias("left_key"), "right_keys", "distance").select("left_key", F.explode("right_keys").alias("right_key"), "distance")


def within_pairs(points: DataFrame, radius: float, key: str, digits: int | None = None) -> DataFrame:
    """The rows of ``within_join`` of the points with themselves that have left_key < right_key, two places compared in one order only."""
    once = F.struct("ax", "ay", "ap") <= F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("bp").alias("ap"))
    near = _near_places(points, points, radius, key, key, once, digits)
    keys = near.select(F.explode("left_keys").alias("k"), "right_keys", "same", "distance").select("k", F.explode("right_keys").alias("l"), "same", "distance")
    keys = keys.filter((F.col("k") < F.col("l")) | (~F.col("same") & (F.col("k") > F.col("l"))))
    return keys.select(F.least("k", "l").alias("left_key"), F.greatest("k", "l").alias("right_key"), "distance")


def random_points(spark, count: int, box: tuple[float, float, float, float] = (-77.2, -12.2, -76.9, -11.9), seed: int = 0) -> DataFrame:
    """(id, x, y) uniform in a box; the same for the same seed however it is split."""
    part = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(k), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    x1, y1, x2, y2 = box
    return spark.range(count).select("id", (part(0) * (x2 - x1) + x1).alias("x"), (part(1) * (y2 - y1) + y1).alias("y"))
