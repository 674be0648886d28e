"""Spatial expressions: distances, boxes, polygons. Points are (x = longitude, y = latitude)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; the SQL function and the library metric use different mean radii.
SQL_RADIUS, LIBRARY_RADIUS = 6371008.8, 6371000.0
METRICS = ("euclidean", "haversine")
FARTHEST = float(1 << 53)


def metric_name(metric: str) -> str:
    name = metric.strip().lower()
    if name not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    return name


def point(lat, lon) -> Column:
    """A point from SQL order (latitude, longitude)."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(col(lon).cast("double").alias("x"), col(lat).cast("double").alias("y"))


def check_point(x: float, y: float, metric: str = "euclidean") -> tuple[float, float]:
    if not (math.isfinite(x) and math.isfinite(y)):
        raise ValueError("coordinates must be finite")
    if metric_name(metric) == "haversine" and not (-180 <= x <= 180 and -90 <= y <= 90):
        raise ValueError(f"({x}, {y}) is no longitude and latitude")
    return float(x), float(y)


def check_radius(radius: float) -> float:
    if not math.isfinite(radius) or radius < 0:
        raise ValueError("a radius is finite and not negative")
    return float(radius)


def euclidean(x1, y1, x2, y2) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def haversine(x1, y1, x2, y2, radius: float = SQL_RADIUS) -> Column:
    """Great-circle distance in metres: 2 R asin(sqrt(h)), h clamped to [0, 1]."""
    lat1, lat2 = F.radians(y1), F.radians(y2)
    a, b = F.sin((lat2 - lat1) / 2), F.sin(F.radians(x2 - x1) / 2)
    h = a * a + F.cos(lat1) * F.cos(lat2) * b * b
    return F.lit(2 * radius) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def distance(x1, y1, x2, y2, metric: str = "euclidean", radius: float = SQL_RADIUS) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    args = [lit(v) for v in (x1, y1, x2, y2)]
    return euclidean(*args) if metric_name(metric) == "euclidean" else haversine(*args, radius=radius)


def in_box(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Inside the box, borders included; each comparison reaches the Parquet scan."""
    return (x >= x1) & (x <= x2) & (y >= y1) & (y <= y2)


def radius_box(x: float, y: float, radius: float, metric: str = "euclidean", earth: float = LIBRARY_RADIUS) -> tuple[float, float, float, float]:
    """A box that holds every point within the radius (a longitude band may be the whole circle)."""
    if metric_name(metric) == "euclidean":
        return x - radius, y - radius, x + radius, y + radius
    slack = 1 + 1e-9
    reach = math.degrees(radius / earth) * slack
    low, high = max(-90.0, y - reach), min(90.0, y + reach)
    if low <= -90 or high >= 90 or reach >= 90:
        return -180.0, low, 180.0, high
    turn = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(y))))) * slack
    if x - turn < -180 or x + turn > 180:
        return -180.0, low, 180.0, high
    return x - turn, low, x + turn, high


@dataclass(frozen=True)
class Polygon:
    """A simple polygon of at least three different corners; a repeated last corner is dropped."""

    corners: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        c = tuple((float(x), float(y)) for x, y in self.corners)
        if len(c) > 1 and c[0] == c[-1]:
            c = c[:-1]
        object.__setattr__(self, "corners", c)
        if len(c) < 3 or len(set(c)) < len(c):
            raise ValueError("a polygon has at least three corners, all different")
        if not all(math.isfinite(v) for p in c for v in p):
            raise ValueError("corners must be finite")
        if abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in self.edges())) == 0:
            raise ValueError("a polygon has an area")
        edges = self.edges()
        for i in range(len(edges)):
            for j in range(i + 1, len(edges)):
                neighbours = j == i + 1 or (i == 0 and j == len(edges) - 1)
                if not neighbours and _touch(*edges[i], *edges[j]):
                    raise ValueError("a polygon does not cross itself")

    def edges(self) -> list[tuple[tuple[float, float], tuple[float, float]]]:
        return list(zip(self.corners, self.corners[1:] + self.corners[:1], strict=True))

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = [p[0] for p in self.corners], [p[1] for p in self.corners]
        return min(xs), min(ys), max(xs), max(ys)


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _touch(a, b, c, d) -> bool:
    s = [_side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)]
    if s[0] * s[1] < 0 and s[2] * s[3] < 0:
        return True
    within = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return any(v == 0 and within(p, q, r) for v, p, q, r in ((s[0], a, b, c), (s[1], a, b, d), (s[2], c, d, a), (s[3], c, d, b)))


def in_polygon(x: Column, y: Column, polygon: Polygon, boundary: bool = True) -> Column:
    """Even-odd rule over the polygon's edges, after its bounding box; points on an edge count if ``boundary``."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in polygon.edges():
        on_edge = on_edge | (((F.lit(bx - ax) * (y - ay) - F.lit(by - ay) * (x - ax)) == 0) & in_box(x, y, min(ax, bx), min(ay, by), max(ax, bx), max(ay, by)))
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax)
            crossings = crossings + F.when(crosses, 1).otherwise(0)
    inside = (crossings % 2 == 1) & ~on_edge
    return in_box(x, y, *polygon.box()) & ((inside | on_edge) if boundary else inside)


def cells(x: Column, y: Column, side: float) -> tuple[Column, Column]:
    """Grid cell of a point, for partition columns and joins. Beyond ``FARTHEST`` cells doubles are a cell or more apart, and all are one cell."""
    cell = lambda c: F.floor(F.least(F.greatest(c / side, F.lit(-FARTHEST)), F.lit(FARTHEST)))
    return cell(x), cell(y)


def polygon_from_latlon(corners: Sequence[tuple[float, float]]) -> Polygon:
    return Polygon(tuple((lon, lat) for lat, lon in corners))
