"""Operator 2: benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .runtime import global_prefix, lean, stored
from .words import PUNCTUATION, SPACES, Hasher, mix, slices, texts

#: Word positions that a seed looks at; the others may differ. Together the two seeds hit
#: every run of 13 words with at most 2 substitutions.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8))
#: Words of an overlap that counts, and substitutions allowed in it.
OVERLAP, SUBSTITUTIONS = 13, 2
SHORTEST = 7
#: Pairs of equal seeds looked at in one go.
AT_ONCE = 1 << 20
#: Bytes of benchmark text in a block; a larger benchmark is gone through block by block.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20

_HASH = Hasher(SPACES + PUNCTUATION)
_ODD = np.random.default_rng(31337).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def allowed(words: int) -> tuple[int, int]:
    """(window, substitutions) for an item of so many words: 2 in 13; 1 from 9 words on, else none."""
    if words >= OVERLAP:
        return OVERLAP, SUBSTITUTIONS
    return words, 1 if words >= 9 else 0


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(sum(1 << o for o in mask)))
    for j, o in enumerate(mask):
        total += hashes[o : o + n] * _ODD[j]
    return mix(total)


class Benchmark:
    """Items of a block, and for each mask the sorted hashes of their windows with a fixed-size filter.

    Items shorter than the masks, if ``shortest`` lets them count, have a mask of all their words.
    """

    def __init__(self, items: list[tuple], shortest: int = SHORTEST) -> None:
        self.shortest = shortest
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        self.ids = [i for i, _ in items]
        self.hashes, _, self.borders = _HASH.rows(np.frombuffer(b"".join(raw), np.uint8), offsets)
        owner = np.repeat(np.arange(len(items)), np.diff(self.borders))
        lengths = np.diff(self.borders)
        few = min(m[-1] for m in MASKS) + 1
        self.tables = []
        for mask in (*MASKS, *(tuple(range(n)) for n in range(max(shortest, 1), few))):
            keys = seeds(self.hashes, mask)
            whole = mask not in MASKS
            at = np.flatnonzero((owner[: len(keys)] == owner[mask[-1] :]) & (~np.bool_(whole) | (lengths[owner[: len(keys)]] == len(mask)))) if len(keys) else np.zeros(0, np.int64)
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (keys[at[1:]] != keys[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(keys[at] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            tables = []
            for some in (at, at[head]):
                some = some[np.argsort(keys[some], kind="stable")]
                tables.append((keys[some], owner[some], some - self.borders[owner[some]]))
            self.tables.append((mask, seen, *tables))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in text, first word in item, aligned words, equal words), the best for each text and item."""
        hashes, _, borders = _HASH.rows(data, offsets)
        owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        hits = [np.zeros((0, 3), np.int64)]
        for mask, seen, every, heads in self.tables:
            keys = seeds(hashes, mask)
            at = np.flatnonzero(seen[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = at[owner[at] == owner[at + mask[-1]]]
            # where words repeat, a pair that goes on from one a word before lies on the same diagonal
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (keys[at[1:]] != keys[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            for some, (table, items, places) in ((at[head], every), (at[~head], heads)):
                lo, hi = np.searchsorted(table, keys[some], "left"), np.searchsorted(table, keys[some], "right")
                sums = np.concatenate([[0], np.cumsum(hi - lo)])
                k = 0
                while k < len(some):
                    stop = max(k + 1, int(np.searchsorted(sums, sums[k] + AT_ONCE, "right")) - 1)
                    n = (hi - lo)[k:stop]
                    which = np.repeat(lo[k:stop] - sums[k:stop] + sums[k], n) + np.arange(n.sum())
                    place = np.repeat(some[k:stop], n)
                    k = stop
                    if len(place):
                        hits.append(np.unique(np.column_stack([owner[place], items[which], place - places[which]]), axis=0))
        best: dict[tuple[int, int], tuple] = {}
        for text, item, start in np.unique(np.concatenate(hits), axis=0).tolist():
            first, length = int(self.borders[item]), int(self.borders[item + 1] - self.borders[item])
            window, errors = allowed(length)
            a, b = max(start, int(borders[text])), min(start + length, int(borders[text + 1]))
            if length < self.shortest or b - a < window:
                continue
            same = hashes[a:b] == self.hashes[first + a - start : first + b - start]
            sums = np.concatenate([[0], np.cumsum(same)])
            if (sums[window:] - sums[:-window]).max() >= window - errors:
                found = (text, item, a - int(borders[text]), a - start, b - a, int(sums[-1]))
                if (text, item) not in best or found[5] > best[text, item][5]:
                    best[text, item] = found
        return [best[k] for k in sorted(best)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded bytes; equal texts are one item under their least id."""
    items = benchmark.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("item"))
    sized = global_prefix(items.withColumn("size", F.octet_length("text").cast("long")).withColumn("digest", F.md5(F.col("text").cast("binary"))), ["digest"], ["size"])
    numbered = stored(sized.select("item", "text", F.floor(F.col("before_size") / BLOCK_BYTES).cast("long").alias("block")), "benchmark")
    for (k,) in sorted(numbered.select("block").distinct().collect()):
        rows = numbered.filter(F.col("block") == k).orderBy("item", "text").collect()  # BLOCK_BYTES and one item at most
        yield Benchmark([(r.item, r.text) for r in rows], shortest)


_FOUND = "doc_word long, item_word long, aligned_words long, equal_words long"


def _finder(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in slices(offsets):
                found = shared.value.find(data, offsets[lo : hi + 1])
                numbers = np.array([f[1:] for f in found], np.int64).reshape(-1, 5)
                ids = pa.array([shared.value.ids[i] for i in numbers[:, 0]], kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array([f[0] for f in found], pa.int64())), ids, *(pa.array(numbers[:, k]) for k in range(1, 5))],
                    names=["row_id", "item_id", "doc_word", "item_word", "aligned_words", "equal_words"],
                )

    return run


def _filter(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(text_at))
            clean = np.ones(batch.num_rows, bool)
            for lo, hi in slices(offsets):
                clean[[lo + f[0] for f in shared.value.find(data, offsets[lo : hi + 1])]] = False
            yield batch.filter(pa.array(clean))

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Benchmark items found in documents, with substitutions but in place, a row per document and item.

    Words are lower-cased (A-Z) and free of ASCII punctuation. Hashes of the words that a
    mask selects join documents with items; around each hit the item is laid along the
    document, and it counts if some 13 words running have at most 2 substitutions (items
    of 9 to 12 words: all with at most 1; shorter ones: none; those below ``shortest``
    words are no evidence).
    The alignment with most equal words is returned: first word in the document and in
    the item, words aligned, words equal.

    Each block of the benchmark (``BLOCK_BYTES``) is broadcast and takes one pass over the
    documents. Null or empty texts on either side have no overlaps; equal benchmark texts
    are one item under their least id; ids on either side may be of any type; null ids and
    repeated documents give rows like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col)).schema.fields[0].dataType
    item = benchmark.select(F.col(item_col)).schema.fields[0].dataType
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("text"))
    out = spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), T.StructField("item_id", item), *T.StructType.fromDDL(_FOUND).fields]))
    for block in blocks(benchmark, item_col, item_text, shortest):
        found = rows.mapInArrow(lean(_finder(spark.sparkContext.broadcast(block), to_arrow_type(item))), f"row_id {kind.simpleString()}, item_id {item.simpleString()}, {_FOUND}")
        out = out.unionByName(found.withColumnRenamed("row_id", id_col))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The documents, all their columns, without those that overlap an item (see ``overlaps``).

    Null and empty texts, null ids and repeated rows stay as they are; without items every
    document stays; an empty table gives an empty result.
    """
    for block in blocks(benchmark, item_col, item_text, shortest):
        docs = docs.mapInArrow(lean(_filter(docs.sparkSession.sparkContext.broadcast(block), docs.columns.index(text_col))), docs.schema)
    return docs


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
