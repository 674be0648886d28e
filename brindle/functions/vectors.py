"""Vector scores as native expressions on arrays; higher is better for every metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "inner_product")


def as_array(v: Sequence[float] | Column) -> Column:
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_similarity(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def score(a: Column, b: Column, metric: str = "euclidean") -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    if metric == "euclidean":
        return 1.0 / (1.0 + euclidean_distance(a, b))
    return cosine_similarity(a, b) if metric == "cosine" else dot(a, b)
