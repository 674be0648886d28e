"""Ranked full-text search: postings, BM25 and TF-IDF cosine over DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.analyzer import analyze, native_analyzer
from brindle.tables import spread

K1, B = 1.2, 0.75


def bm25_weight(tf: Column, length: Column, df: Column, n: Column, avg: Column, qtf: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    norm = F.when(avg > 0, tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / avg))).otherwise(0.0)
    return qtf * idf * norm


def check_bm25(k1: float, b: float) -> None:
    if not (k1 > 0 and k1 < float("inf") and 0 <= b <= 1):
        raise ValueError("k1 is positive and finite, b is from 0 to 1")


def query_terms(spark: SparkSession, query: str, tokens: Callable[[Column], Column] | None = None) -> Counter:
    """Terms of one query and how often each occurs; a one-row job where the analyzer is a column function."""
    if tokens is None:
        return Counter(analyze(query))
    return Counter(spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q"))).first()[0])


@dataclass
class TextIndex:
    """Derived tables of a corpus: postings (term, id, tf), lengths (id, length), terms (term, df), totals in one row.

    Documents with a null text are not part of the corpus; empty texts are.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    key: str
    tokens: Callable[[Column], Column]
    saved_norms: DataFrame | None = None  # of a saved index, until it changes

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, tokens: Callable[[Column], Column] | None = None) -> TextIndex:
        tokens = tokens or native_analyzer()
        docs = spread(df.filter(F.col(text).isNotNull()).select(key, text)).select(key, tokens(F.col(text)).alias("tokens"))
        lengths = docs.select(key, F.size("tokens").cast("long").alias("length"))
        postings = docs.select(key, F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
        return cls(postings, lengths, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), key, tokens)

    def save(self, folder: str) -> TextIndex:
        """Write the tables; postings in order of their term, so that a query reads few row groups."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term", self.key).sortWithinPartitions("term").write.parquet(f"{folder}/postings")
        self.lengths.write.parquet(f"{folder}/lengths")
        saved = spark.read.parquet(f"{folder}/postings")
        saved.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        written = TextIndex(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "lengths", "terms")), self.key, self.tokens)
        written.norms().write.parquet(f"{folder}/norms")
        return self.open(spark, folder, self.key, self.tokens)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, key: str, tokens: Callable[[Column], Column] | None = None) -> TextIndex:
        postings, lengths, terms, norms = (spark.read.parquet(f"{folder}/{t}") for t in ("postings", "lengths", "terms", "norms"))
        return cls(postings, lengths, terms, key, tokens or native_analyzer(), norms)

    def remove(self, keys: DataFrame, key: str) -> TextIndex:
        """Without the documents of these keys; unknown ones change nothing."""
        gone = keys.select(F.col(key).alias(self.key)).distinct()
        lost = self.postings.join(gone, self.key, "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("lost"))
        terms = self.terms.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")).filter("df > 0")
        return TextIndex(self.postings.join(gone, self.key, "left_anti"), self.lengths.join(gone, self.key, "left_anti"), terms, self.key, self.tokens)

    def insert(self, df: DataFrame, text: str) -> TextIndex:
        """With these documents, which take the place of those with the same key; ``df`` has each key once."""
        old, new = self.remove(df, self.key), TextIndex.build(df, self.key, text, self.tokens)
        terms = old.terms.unionByName(new.terms).groupBy("term").agg(F.sum("df").alias("df"))
        return TextIndex(old.postings.unionByName(new.postings), old.lengths.unionByName(new.lengths), terms, self.key, self.tokens)

    def totals(self) -> DataFrame:
        return self.lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("avg_length"))

    def _query(self, query: str) -> tuple[DataFrame, Column]:
        """The query's terms with their counts, and a filter on them.

        The filter stands beside the join because it is pushed below the grouping of
        terms, and to the scan of saved tables.
        """
        spark = self.postings.sparkSession
        counts = query_terms(spark, query, self.tokens)
        rows = [(t, float(c)) for t, c in sorted(counts.items())]
        return spark.createDataFrame(rows, "term string, qtf double"), F.col("term").isin(*sorted(counts))

    def bm25(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score) of the documents that share a term with the query."""
        check_bm25(k1, b)
        q, named = self._query(query)
        known = F.broadcast(self.terms.filter(named).join(F.broadcast(q), "term"))  # at most the query's terms
        hits = self.postings.filter(named).join(known, "term").join(self.lengths, self.key).crossJoin(F.broadcast(self.totals()))
        weight = bm25_weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n"), F.col("avg_length"), F.col("qtf"), k1, b)
        return hits.groupBy(self.key).agg(F.sum(weight).alias("score"))

    def norms(self) -> DataFrame:
        """(id, norm) over all terms of each document; a saved index has them written."""
        if self.saved_norms is not None:
            return self.saved_norms
        weighted = self.postings.join(self.terms, "term").crossJoin(F.broadcast(self.totals()))
        w = F.col("tf") * F.log(F.col("n") / F.col("df"))
        return weighted.groupBy(self.key).agg(F.sqrt(F.sum(w * w)).alias("norm"))

    def tf_idf(self, query: str) -> DataFrame:
        """(id, score): cosine of raw tf times ln(N / df) vectors; 0 where either norm is 0."""
        q, named = self._query(query)
        known = self.terms.filter(named).join(F.broadcast(q), "term").crossJoin(F.broadcast(self.totals())).withColumn("idf", F.log(F.col("n") / F.col("df")))
        length = F.broadcast(known.agg(F.sqrt(F.sum((F.col("qtf") * F.col("idf")) ** 2)).alias("q_norm")))
        hits = self.postings.filter(named).join(F.broadcast(known), "term").groupBy(self.key).agg(F.sum(F.col("qtf") * F.col("tf") * F.col("idf") * F.col("idf")).alias("dot"))
        scored = hits.join(self.norms(), self.key).crossJoin(length)
        cosine = F.when((F.col("norm") > 0) & (F.col("q_norm") > 0), F.col("dot") / (F.col("norm") * F.col("q_norm"))).otherwise(0.0)
        return scored.select(self.key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)).alias("score"))

    def scores(self, query: str, method: str = "bm25", **options) -> DataFrame:
        method = method.lower().replace("-", "_")
        if method == "bm25":
            return self.bm25(query, **options)
        if method in ("tf_idf", "tfidf"):
            return self.tf_idf(query)
        raise ValueError(f"method {method!r} is neither bm25 nor tf_idf")

    def match_top_k(self, query: str, k: int, method: str = "bm25", **options) -> DataFrame:
        """Best k of the documents that share a term (score descending, then key)."""
        return self.scores(query, method, **options).orderBy(F.desc("score"), self.key).limit(k)

    def top_k(self, query: str, k: int, method: str = "bm25", **options) -> DataFrame:
        """Best k of all documents; those without a shared term score 0."""
        found = self.scores(query, method, **options)
        every = self.lengths.select(self.key).join(found, self.key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return every.orderBy(F.desc("score"), self.key).limit(k)

    def match_batch(self, queries: DataFrame, k: int, query_key: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
        """BM25 for many queries in one job: query terms join the postings, a group limit ranks."""
        from pyspark.sql import Window

        terms = queries.select(F.col(query_key), F.explode(self.tokens(F.col(text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
        hits = self.postings.join(terms, "term").join(self.terms, "term").join(self.lengths, self.key).crossJoin(F.broadcast(self.totals()))
        weight = bm25_weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n"), F.col("avg_length"), F.col("qtf"), k1, b)
        scored = hits.groupBy(query_key, self.key).agg(F.sum(weight).alias("score"))
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.round("score", 9).desc(), self.key))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def scan_bm25(df: DataFrame, key: str, text: str, query: str, tokens: Callable[[Column], Column] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 without an index, in two scans and no shuffle of tokens: one row of statistics, then scores.

    Only the query's terms are counted. Returns all columns of the matching rows and ``score``.
    """
    check_bm25(k1, b)
    spark = df.sparkSession
    tokens = tokens or native_analyzer()
    counts = sorted(query_terms(spark, query, tokens).items())
    terms = [t for t, _ in counts]
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator keeps what is behind it from being computed again at each use
    docs = spread(df.filter(F.col(text).isNotNull())).select("*", once(tokens(F.col(text))).alias("_tokens"))
    docs = docs.withColumn("_seen", once(F.struct(F.size("_tokens").alias("n"), F.filter("_tokens", lambda w: w.isin(*terms)).alias("hits")))).drop("_tokens")
    times = lambda t: F.size(F.filter("_seen.hits", lambda w: w == F.lit(t)))
    docs = docs.withColumn("_tf", F.array(*map(times, terms)) if terms else F.array().cast("array<int>"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("_seen.n").alias("avg"), *(F.sum((F.col("_tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(counts)))).first()
    score = F.lit(0.0)
    for i, (_, c) in enumerate(counts):
        if stats[f"df{i}"]:
            tf = F.col("_tf")[i]
            weight = bm25_weight(tf, F.col("_seen.n"), F.lit(float(stats[f"df{i}"])), F.lit(float(stats["n"])), F.lit(float(stats["avg"])), F.lit(float(c)), k1, b)
            score = score + F.when(tf > 0, weight).otherwise(0.0)
    hit = F.exists("_tf", lambda v: v > 0)
    return docs.filter(hit).withColumn("score", score).drop("_seen", "_tf")


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """Per query: hits among the first k (column rank), precision hits / k, recall hits / relevant (null without any)."""
    good = relevant.select(query_key, key).distinct()
    total = good.groupBy(query_key).agg(F.count(F.lit(1)).alias("n_relevant"))
    first = ranked.filter(F.col("rank") <= k).select(query_key, key)
    hits = first.join(good, [query_key, key]).groupBy(query_key).agg(F.count(F.lit(1)).alias("hits"))
    every = ranked.select(query_key).union(good.select(query_key)).distinct()
    out = every.join(total, query_key, "left").join(hits, query_key, "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return out.select(query_key, "hits", (F.col("hits") / F.lit(k)).alias("precision"), F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).alias("recall"))


def query_length_variants(queries: DataFrame, key: str, text: str, lengths: tuple[int, ...] = (1, 3)) -> DataFrame:
    """For queries of five words or more: their first 1 and 3 words and the whole, as variants."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    long = queries.filter(F.size(words) >= 5)
    parts = [long.select(key, F.lit(str(n)).alias("variant"), F.concat_ws(" ", F.slice(words, 1, n)).alias(text)) for n in lengths]
    out = long.select(key, F.lit("5+").alias("variant"), F.col(text))
    for p in parts:
        out = p.unionByName(out)
    return out


def nested_sample(df: DataFrame, key: str, sizes: tuple[int, ...], seed: int = 0) -> dict[int, DataFrame]:
    """Samples of which each holds the smaller ones: the least SHA-256 of seed and key come first."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return {n: df.orderBy(order, key).limit(n) for n in sorted(sizes)}
