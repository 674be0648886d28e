"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches, filesystem, lean, new_folder
from .words import PUNCTUATION, SPACES, Hasher, mix, slices, texts

#: Bounds: labelled rows of the fit; hash buckets (a bit count), which bound the weights.
FIT_ROWS, BITS = 16_000, 20
ALPHA, BETA, L1, L2, PASSES, RAREST = 0.1, 1.0, 12.0, 1.0, 3, 3
#: The bias without any example: nothing is toxic.
NO_EXAMPLES = -35.0
FOLDS = 5

_HASH = Hasher(SPACES + PUNCTUATION)
_PAIR = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SKIP = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word, word pair and pair of words around one other, inside texts.

    Words are lower-cased (A-Z) and free of ASCII punctuation.
    """
    h, _, borders = _HASH.rows(data, offsets)
    owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    shift = np.uint64(64 - BITS)
    keys, texts_ = [h >> shift], [owner]
    for gap, (a, b) in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            near = owner[gap:] == owner[:-gap]
            keys.append(mix(h[:-gap][near] * a + h[gap:][near] * b) >> shift)
            texts_.append(owner[gap:][near])
    return np.concatenate(keys).astype(np.int64), np.concatenate(texts_)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text, as little-endian 32-bit numbers."""
    for batch in batches:
        data, offsets = texts(batch.column(2))
        for lo, hi in slices(offsets):
            keys, owner = buckets(data, offsets[lo : hi + 1])
            both = np.unique((owner << BITS) | keys)
            cuts = np.searchsorted(both >> BITS, np.arange(hi - lo + 1)) * 4
            raw = (both & ((1 << BITS) - 1)).astype("<u4").tobytes()
            packed = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["turn", "label", "keys"])


def ftrl(examples: Iterable[tuple[np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) after per-coordinate FTRL-proximal steps over the examples in turn.

    Each coordinate has its own rate alpha / (beta + sqrt(sum of squared gradients)) and is
    exactly zero while its accumulated gradient stays under ``L1``. Buckets of fewer than
    ``RAREST`` examples take no part. Rows of the rarer label weigh more, up to 3 times.
    The examples are gone through once more than ``passes`` and never held together.
    """
    size = 1 << BITS
    seen = np.zeros(size, np.int32)
    rows = ones = 0
    for keys, y in examples:
        seen[keys] += 1
        rows, ones = rows + 1, ones + y
    z, n = np.zeros(size), np.zeros(size)
    bias_z, bias_n, bias = 0.0, 0.0, 0.0 if rows else NO_EXAMPLES
    heavy = min(3.0, max(1.0, (rows - ones) / max(ones, 1)))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(passes):
        for keys, y in examples:
            keys = keys[seen[keys] >= RAREST]
            zi, ni = z[keys], n[keys]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = (p - y) * (heavy if y else 1.0)
            root = np.sqrt(ni + g * g)
            z[keys] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[keys] = ni + g * g
            bias_root = np.sqrt(bias_n + g * g)
            bias_z += g - (bias_root - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
            bias = -bias_z / ((BETA + bias_root) / ALPHA)
    w = weights(z, n)
    used = np.flatnonzero(w)
    return used, w[used], float(bias)


class _Rows:
    """The first ``FIT_ROWS`` (buckets, label) of a folder with one sorted Parquet file, read anew each time, some rows at once."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        import pyarrow.dataset as ds

        system, path = filesystem(self.folder)
        # batches in turn, without reading ahead of them
        files = ds.dataset(path, format="parquet", filesystem=system)
        if not files.files:
            return
        found = files.to_batches(columns=["keys", "label"], batch_size=32, batch_readahead=0, fragment_readahead=0, use_threads=False)
        rows = ((k.as_buffer(), y.as_py()) for b in found for k, y in zip(b.column(0), b.column(1), strict=True))
        for k, y in islice(rows, FIT_ROWS):
            yield np.frombuffer(k, "<u4"), int(y > 0)


def _trainer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in batches):
            used, w, bias = ftrl(_Rows(folder))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], used]), pa.int64()), pa.array(np.concatenate([[bias], w]))], names=["bucket", "weight"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS) -> dict[int, float]:
    """Weights by bucket, bias at -1, from labelled rows outside the held-out fold.

    At most ``FIT_ROWS`` labelled rows, the first by hash of their id, take part, with
    their whole texts; one task steps through a sorted file of them, so neither long texts
    nor repeated ids are held together. Null ids and labels mark nothing; without labelled
    rows nothing is scored as toxic. Rows equal in id, text and label are alike, so a rerun
    gives the same weights.
    """
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != 0)).select(F.col(id_col).alias("row_id"), F.col(label_col).cast("int").alias("label"))
    turn = F.xxhash64(F.col("row_id"))
    sample = marked.orderBy(turn, "row_id", "label").limit(FIT_ROWS)
    fit = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(sample), "row_id")  # at most FIT_ROWS rows
    keys = fit.select(turn.alias("turn"), "label", "text").mapInArrow(lean(_features), "turn long, label int, keys binary")
    folder = new_folder(spark, "fit")
    keys.repartition(1).sortWithinPartitions("turn", F.length("keys"), "keys", "label").write.option("parquet.block.size", 4 << 20).parquet(folder)
    return dict(spark.range(0, 1, 1, 1).mapInArrow(lean(_trainer(folder)), "bucket long, weight double").collect())


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        used, weights, bias = shared.value
        table[used] = weights
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in slices(offsets):
                keys, owner = buckets(data, offsets[lo : hi + 1])
                w = table[keys]
                hit = np.flatnonzero(w)
                both = np.unique((owner[hit] << BITS) | keys[hit])
                total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], hi - lo) + bias
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns) if i != 1), pa.array(score)], names=[*(c for i, c in enumerate(batch.schema.names) if i != 1), "score"])

    return run


def _broadcast(spark, weights: dict[int, float]):
    bound_batches(spark)
    used = sorted(k for k in weights if k >= 0)
    return spark.sparkContext.broadcast((np.array(used, np.int64), np.array([weights[k] for k in used]), weights.get(-1, NO_EXAMPLES)))


def score_toxicity(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """Score every whole text with the sparse weights (at most 2 ** BITS, most are zero).

    A null or empty text has the bias alone. Null ids and repeated rows are scored like
    any other; a null id counts as the text '' for the fold. Scores depend on the text
    alone. Returns id, held_out, score, predicted.
    """
    shared = _broadcast(docs.sparkSession, weights)
    ddl = docs.select(F.col(id_col)).schema.fields[0].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(lean(_scorer(shared)), f"row_id {ddl}, score double")
    fold = F.crc32(F.coalesce(F.col("row_id").cast("string"), F.lit("")).cast("binary")) % folds
    return scored.select(F.col("row_id").alias(id_col), (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Scores of all documents by a model fitted on the labels; odd input as in ``fit_toxicity`` and ``score_toxicity``."""
    return score_toxicity(docs, fit_toxicity(docs, labels, id_col, text_col, label_col), id_col, text_col)


def _dropper(shared, text_at: int):
    scores = _scorer(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(text_at)], names=["row_id", "text"])
            score = np.concatenate([np.zeros(0), *(b.column(1).to_numpy() for b in scores(iter([two])))])
            yield batch.filter(pa.array(score < 0.5))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents, all their columns, without those predicted toxic.

    Null and empty texts have the score of the bias alone; null ids and repeated rows are
    judged by their text like any other; an empty table gives an empty result.
    """
    shared = _broadcast(docs.sparkSession, fit_toxicity(docs, labels, id_col, text_col, label_col))
    return docs.mapInArrow(lean(_dropper(shared, docs.columns.index(text_col))), docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
