"""Bag of visual or audio words: histograms over a codebook, smoothed IDF, unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.vector import assigned


def histograms(descriptors: DataFrame, key: str, vector: str, codebook: Sequence[Sequence[float]]) -> DataFrame:
    """(key, word, count): how many of an item's descriptors are nearest to each word; descriptors with nulls have none."""
    words = assigned(descriptors, key, vector, codebook).select(F.col("key").alias(key), F.col("list_id").alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("count"))


def smoothed_idf(counts: DataFrame, key: str) -> DataFrame:
    """(word, idf): ln((n + 1) / (df + 1)) + 1 over the items that have words."""
    n = counts.select(F.count_distinct(key).alias("n"))
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("word", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def tfidf_vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, word, weight): counts times IDF, scaled to unit length (sparse; zero stays zero)."""
    weighted = counts.join(F.broadcast(idf), "word").withColumn("w", F.col("count") * F.col("idf"))  # one row a codebook word
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, key).select(key, "word", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("weight"))


def dense(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """(key, vector): the sparse weights as arrays of ``size`` numbers."""
    by_word = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("m"))  # at most ``size`` entries
    return by_word.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vector"))


def train_codebook(descriptors: DataFrame, vector: str, words: int, sample: int = 10_000, seed: int = 0) -> list[list[float]]:
    """Codebook of a bounded sample of descriptors, the first by hash."""
    import numpy as np

    from brindle.operators.vector import kmeans

    rows = descriptors.select(vector).orderBy(F.xxhash64(F.col(vector), F.lit(seed))).limit(sample).collect()
    return kmeans(np.array([list(r[0]) for r in rows], float), words, seed=seed).tolist()


def save_codebook(spark, codebook: Sequence[Sequence[float]], idf: DataFrame, path: str) -> None:
    """(word, centroid, idf) as Parquet; words without an IDF have null."""
    words = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(codebook)], "word int, centroid array<double>")
    words.join(idf, "word", "left").coalesce(1).write.mode("overwrite").parquet(path)


def load_codebook(spark, path: str) -> tuple[list[list[float]], DataFrame]:
    rows = spark.read.parquet(path)
    return [list(r.centroid) for r in rows.orderBy("word").select("centroid").collect()], rows.filter("idf is not null").select("word", "idf")
