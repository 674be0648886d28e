"""Vector search: exact, inverted lists (IVF) and an approximate graph contract; k-means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.vectors import METRICS, as_array, score
from brindle.operators.blocks import BLOCK, nearest_in_blocks

NLIST, NPROBE, SAMPLE, ITERATIONS = 32, 4, 10_000, 20
#: Least mean recall, and the keys it is measured on: those divisible by EVERY, at most QUERIES of them by hash.
RECALL, EVERY, QUERIES = 0.9, 20, 500


def top_k(df: DataFrame, query: Sequence[float], k: int, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """Exact best k by score, then key; each task keeps its own best k. Rows without a whole vector are not found."""
    return _whole(df, vector).select(key, score(F.col(vector), as_array(query), metric).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _numpy_scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "inner_product":
        return rows @ queries.T
    if metric == "cosine":
        both = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None]
        return np.divide(rows @ queries.T, both, out=np.zeros((len(rows), len(queries))), where=both > 0)
    square = (rows**2).sum(1)[:, None] + (queries**2).sum(1)[None] - 2 * rows @ queries.T
    return 1 / (1 + np.sqrt(np.maximum(square, 0)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _whole(df: DataFrame, vector: str) -> DataFrame:
    """The rows that have a vector without nulls in it; others are found by no search."""
    return df.filter(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull()))


def top_k_batch(df: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str, query_vector: str, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """Exact best k for each query of a stated set: blocks of queries meet all rows in matrix products.

    A task keeps k rows for each query, so what is shuffled is k times tasks times queries.
    Keys keep their type; rows without a whole vector are not found, such queries find nothing.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    rows = _whole(df, vector).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    asked = _whole(queries, query_vector).select(F.col(query_key).alias("query_id"), query_vector)
    found = nearest_in_blocks(rows, 1, asked, k, lambda batch, q: -_numpy_scores(_matrix(batch.column(1)), q, metric).T, block)
    return found.select("query_id", F.col("key").alias(key), (-F.col("distance")).alias("score"), "rank")


def kmeans(sample: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 0) -> np.ndarray:
    """Lloyd's iterations from k-means++ seeds on a bounded sample; empty clusters are seeded anew."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centres, d = sample[rng.integers(len(sample))][None], np.full(len(sample), np.inf)
    while len(centres) < k:
        d = np.minimum(d, ((sample - centres[-1]) ** 2).sum(1))
        pick = rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))
        centres = np.concatenate([centres, sample[pick][None]])
    last = None
    for _ in range(iterations):
        square = (sample**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * sample @ centres.T
        near = square.argmin(1)
        if last is not None and (near == last).all():
            break
        last = near
        for c in range(k):
            own = sample[near == c]
            centres[c] = own.mean(0) if len(own) else sample[rng.integers(len(sample))]
    return centres.astype(np.float32).astype(np.float64)


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the first on ties; distances stand in memory for one centroid at a time."""
    least, near = np.full(len(rows), np.inf), np.zeros(len(rows), np.int32)
    for i, c in enumerate(centroids):
        d = ((rows - c) ** 2).sum(1)
        closer = d < least
        least[closer], near[closer] = d[closer], i
    return near


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            near = _nearest(rows, centroids) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["key", "vector", "list_id"])

    return run


def assigned(df: DataFrame, key: str, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(key, vector, list_id): the nearest centroid of each row that has a whole vector, the first on ties."""
    kind, array = df.schema[key].dataType.simpleString(), df.schema[vector].dataType.simpleString()
    rows = _whole(df, vector).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return rows.mapInArrow(_assign(np.array(centroids, np.float64)), f"key {kind}, vector {array}, list_id int")


@dataclass
class IVFIndex:
    """Vectors dealt to their nearest centroid; a search reads the ``nprobe`` lists best for the query.

    Where it is not given, ``nprobe`` is the least from ``NPROBE`` on with a measured mean recall of ``RECALL``.
    """

    lists: DataFrame  # key, vector, list_id
    centroids: list[list[float]]
    key: str
    measured: dict = field(default_factory=dict)

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, nlist: int = NLIST, sample: int = SAMPLE, iterations: int = ITERATIONS, seed: int = 0, centroids: Sequence[Sequence[float]] | None = None) -> IVFIndex:
        """Centroids come from at most ``sample`` rows, the first by hash of the key, unless they are given."""
        if centroids is None:
            rows = _whole(df, vector).select(vector).orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(sample).toArrow().column(0).combine_chunks()
            centroids = kmeans(_matrix(rows), nlist, iterations, seed).tolist()
        lists = assigned(df, key, vector, centroids)
        return cls(lists, [list(map(float, c)) for c in centroids], key)

    def save(self, folder: str) -> IVFIndex:
        """Lists become partition folders: a search reads only those it probes."""
        spark = self.lists.sparkSession
        self.lists.repartition("list_id", F.pmod(F.hash("key"), F.lit(8))).write.partitionBy("list_id").parquet(f"{folder}/lists")
        spark.createDataFrame(list(enumerate(self.centroids)), "list_id int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        return self.open(spark, folder, self.key)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, key: str) -> IVFIndex:
        centroids = [list(r[1]) for r in sorted(spark.read.parquet(f"{folder}/centroids").collect())]
        return cls(spark.read.parquet(f"{folder}/lists"), centroids, key)

    def probes(self, query: Sequence[float], metric: str, nprobe: int) -> list[int]:
        s = np.round(_numpy_scores(np.array(self.centroids), np.array([query], np.float64), metric)[:, 0], 9)
        return [int(i) for i in np.lexsort((np.arange(len(s)), -s))[: min(nprobe, len(s))]]

    def recalls(self, k: int, metric: str = "euclidean") -> np.ndarray:
        """Mean recall of the best k for 1, 2 ... lists probed, over keys (or their hashes) divisible by ``EVERY`` against all rows."""
        if (k, metric) not in self.measured:
            number = F.col("key") if isinstance(self.lists.schema["key"].dataType, T.IntegralType) else F.xxhash64("key")
            some = self.lists.filter(number % EVERY == 0).orderBy(F.xxhash64("key"), "key").limit(QUERIES)
            queries = {r["key"]: list(r["vector"]) for r in some.select("key", "vector").collect()}
            if not queries:
                return np.ones(len(self.centroids))
            kind = self.lists.schema["key"].dataType.simpleString()
            asked = self.lists.sparkSession.createDataFrame(list(queries.items()), f"qid {kind}, v array<double>")
            best = top_k_batch(self.lists, asked, k, "key", "vector", "qid", "v", metric)
            found = best.join(self.lists.select("key", "list_id"), "key").groupBy("query_id").agg(F.collect_list("list_id").alias("ids")).collect()
            shares = []
            for q, ids in found:
                order = np.argsort(self.probes(queries[q], metric, len(self.centroids)))
                shares.append(np.bincount(order[ids], minlength=len(order)).cumsum() / len(ids))
            self.measured[k, metric] = np.mean(shares, axis=0)
        return self.measured[k, metric]

    def enough(self, k: int, metric: str = "euclidean", least: int = NPROBE) -> int:
        """The least number of lists, from ``least`` on, whose measured recall is ``RECALL``."""
        if least >= len(self.centroids):
            return least
        good = np.flatnonzero(self.recalls(k, metric) >= RECALL - 1e-9) + 1
        return int(max(least, good[0]))

    def top_k(self, query: Sequence[float], k: int, metric: str = "euclidean", nprobe: int | None = None) -> DataFrame:
        nprobe = self.enough(k, metric) if nprobe is None else nprobe
        near = self.lists.filter(F.col("list_id").isin(self.probes(query, metric, nprobe)))
        return top_k(near, query, k, "key", "vector", metric).withColumnRenamed("key", self.key)

    def insert(self, rows: DataFrame, key: str, vector: str) -> IVFIndex:
        new = IVFIndex.build(rows, key, vector, centroids=self.centroids)
        return IVFIndex(self.lists.unionByName(new.lists), self.centroids, self.key)

    def remove(self, keys: DataFrame, key: str) -> IVFIndex:
        gone = keys.select(F.col(key).alias("key")).distinct()
        return IVFIndex(self.lists.join(gone, "key", "left_anti"), self.centroids, self.key)


def graph_top_k(df: DataFrame, query: Sequence[float], k: int, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """The contract of an approximate graph index (k best, descending), met exactly: recall is 1."""
    return top_k(df, query, k, key, vector, metric)


def recall_at_k(found: DataFrame, exact: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """Share of each query's exact best k that were found."""
    hits = exact.join(found.select(query_key, key).distinct(), [query_key, key]).groupBy(query_key).agg(F.count(F.lit(1)).alias("hits"))
    every = exact.select(query_key).distinct().join(hits, query_key, "left")
    return every.select(query_key, (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


def random_vectors(spark: SparkSession, count: int, dimension: int, seed: int = 0) -> DataFrame:
    """(id, vector) uniform in [-1, 1); the same for the same seed however it is split."""
    part = lambda j: F.pmod(F.xxhash64(F.col("id"), F.lit(j), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0
    return spark.range(count).select("id", F.array(*(part(j).cast("float") for j in range(dimension))).alias("vector"))
