"""Operator 10: quality rules, base limits and an isolation forest on rule statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import global_prefix, stored
from .words import Hasher, mix, slices, texts, windows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: An isolation forest: trees, rows that a tree draws from all labelled ones, share of low-quality rows among those.
TREES, TREE_ROWS, CONTAMINATION = 40, 256, 0.01
#: Share of good labelled rows that each calibrated threshold may reject.
MAX_LOSS = 0.0005
SEED = 11
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_per_char", "upper_share", "marks_per_word", "repeat_share", "dup_line_share", "same_as_last_share", "mean_word_chars")
#: A forest for each pair of neighbouring statistics, since few odd ones are enough, one for all together, and one for
#: each statistic: in a pair, good rows odd in one statistic may hide low-quality rows odd in the other, as the draws fall.
VIEWS = (*((k, (k + 1) % len(FEATURES)) for k in range(len(FEATURES))), tuple(range(len(FEATURES))), *((k,) for k in range(len(FEATURES))))
SCORES = tuple(f"score_{k}" for k in range(len(VIEWS)))

_HASH = Hasher(fold=False)


def _table(values: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(values)] = True
    return t


_LEADS = np.array([(b & 0xC0) != 0x80 and b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_TABLES = {"chars": _LEADS, "symbols": _table(SYMBOLS), "upper": _table(bytes(range(65, 91))), "letters": _table(bytes([*range(65, 91), *range(97, 123)])), "marks": _table(b"!?")}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _dup_lines(data: bytes) -> tuple[int, int]:
    """Lines that have a word and equal an earlier line; lines that have a word."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and features of the texts data[offsets[i]:offsets[i+1]]."""
    base, offsets = int(offsets[0]), offsets - offsets[0]
    data = data[base : base + int(offsets[-1])]
    out = {k: _per_text(t[data], offsets) for k, t in _TABLES.items()}
    hashes, _, borders = _HASH.rows(data, offsets)
    n = np.diff(borders)
    runs, begins = windows(hashes, borders, 5)
    counts = np.diff(begins)
    owner = np.repeat(np.arange(len(n)), counts)
    keys = runs ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    twin = np.zeros(len(keys), bool)
    same = ranked[1:] == ranked[:-1]
    twin[order[1:]] = same
    twin[order[:-1]] |= same
    at = (np.arange(len(keys)) - np.repeat(begins[:-1], counts) + np.repeat(borders[:-1], counts))[twin]
    cover = np.zeros(len(hashes) + 6, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    covered = np.cumsum(cover)[: len(hashes)] > 0
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[borders[:-1][n > 0]] = False
    lines = [_dup_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    dup, with_word = (np.array(x, np.int64) for x in (zip(*lines, strict=True) if lines else ((), ())))
    words = np.maximum(n, 1)
    repeats = _per_text(covered, borders)
    return {
        "n_words": n.astype(np.int64),
        "word_chars": out["chars"],
        "n_symbols": out["symbols"],
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "symbols_per_char": np.sqrt(out["symbols"] / np.maximum(out["chars"], 1)),
        "upper_share": out["upper"] / np.maximum(out["letters"], 1),
        "marks_per_word": np.sqrt(out["marks"] / words),
        "repeat_share": np.sqrt(repeats / words),
        "dup_line_share": np.sqrt(dup / np.maximum(with_word, 1)),
        "same_as_last_share": np.sqrt(_per_text(again, borders) / words),
        "mean_word_chars": np.minimum(out["chars"] / words, 50.0),
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column(1))
        for lo, hi in slices(offsets):
            s = statistics(data, offsets[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(s[k]) for k in (*COUNTS, *FEATURES))], names=["row_id", *COUNTS, *FEATURES])


def _average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draws(n: int, trees: int, size: int, seed: int) -> list[np.ndarray]:
    """For each tree the numbers, of 0 to n - 1, of the rows that it sees."""
    rng = np.random.default_rng(seed)
    return [rng.choice(n, min(size, n), replace=False) for _ in range(trees)]


class IsolationForest:
    """Random trees as arrays: a node has a feature and a split, or (feature -1) a path length."""

    def __init__(self, rows: np.ndarray, trees: int, size: int, seed: int) -> None:
        self._build([rows[d] for d in draws(len(rows), trees, size, seed)], seed)

    @classmethod
    def of(cls, samples: list[np.ndarray], seed: int) -> IsolationForest:
        """A forest of trees whose rows are drawn already."""
        forest = cls.__new__(cls)
        forest._build(samples, seed)
        return forest

    def _build(self, samples: list[np.ndarray], seed: int) -> None:
        rng = np.random.default_rng([seed, 1])
        self.size = len(samples[0])
        self.limit = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(rows, rng) for rows in samples]

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, value, child, stack = [-1], [0.0], [0], [(0, rows, 0)]
        while stack:
            node, part, depth = stack.pop()
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if depth >= self.limit or len(part) <= 1 or not len(free):
                value[node] = depth + float(_average_path(len(part)))
                continue
            f = int(rng.choice(free))
            cut = rng.uniform(low[f], high[f])
            left = part[:, f] < cut
            feature[node], value[node], child[node] = f, cut, len(feature)
            for side in (part[left], part[~left]):
                feature.append(-1)
                value.append(0.0 if len(side) else float(depth + 1))
                child.append(0)
                if len(side):
                    stack.append((len(feature) - 1, side, depth + 1))
        return np.array(feature), np.array(value), np.array(child)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that few random splits isolate."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, child in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.limit + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(f, 0)] >= value[at]
                at = np.where(inner, child[at] + right, at)
            total += value[at]
        return 2.0 ** (-(total / len(self.trees)) / max(float(_average_path(self.size)), 1e-9))


def _threshold(fine: np.ndarray, bad: np.ndarray) -> float:
    """The score that best parts the labels while it rejects at most ``MAX_LOSS`` of the good rows."""
    fine, bad = np.sort(fine), np.sort(bad)
    least = fine[max(0, int(np.ceil(len(fine) * (1 - MAX_LOSS))) - 1)]
    every = np.unique(np.concatenate([fine, bad]))
    cuts = every[every >= least]
    caught = len(bad) - np.searchsorted(bad, cuts, "right")
    lost = len(fine) - np.searchsorted(fine, cuts, "right")
    best = int(np.argmax(caught / max(len(bad), 1) - lost / len(fine)))
    return float((cuts[best] + cuts[best + 1]) / 2) if best + 1 < len(cuts) else 1.0


def _low_rows(well: int, ill: int) -> int:
    """How many low-quality rows trees may see beside all the good ones."""
    return min(ill, int(np.ceil(well * CONTAMINATION / (1 - CONTAMINATION))))


def fit_forests(rows: np.ndarray, good: np.ndarray, seed: int = SEED) -> list[tuple[tuple[int, ...], IsolationForest, float]] | None:
    """(statistics, forest, threshold) for each view, from labelled rows in a random order; None without good rows.

    Trees see good rows with a small share of low-quality ones. ``quality_rules`` fits the same without bringing all rows to one place.
    """
    well, ill = rows[good], rows[~good]
    if not len(well):
        return None
    seen = np.concatenate([well, ill[: _low_rows(len(well), len(ill))]])
    out = []
    for k, view in enumerate(VIEWS):
        forest = IsolationForest(seen[:, view], TREES, TREE_ROWS, seed + k)
        out.append((view, forest, _threshold(forest.scores(well[:, view]), forest.scores(ill[:, view]))))
    return out


def _forests(fit: DataFrame, seed: int = SEED) -> list[IsolationForest] | None:
    """The forest of each view from all rows (row_id, good 0 or 1, features); None without good rows.

    Rows are numbered in the order of their id's hash, trees draw numbers, and only rows that a tree drew come to the driver.
    """
    spark = fit.sparkSession
    numbered = global_prefix(fit.withColumn("turn", F.xxhash64("row_id")), ["turn", "row_id", "good", *FEATURES], ["good"])
    total = numbered.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("well"), F.count(F.lit(1)).alias("n")).first()
    if not total.well:
        return None
    drawn = [draws(total.well + _low_rows(total.well, total.n - total.well), TREES, TREE_ROWS, seed + k) for k in range(len(VIEWS))]
    asked = np.unique(np.concatenate([d for view in drawn for d in view]))  # at most len(VIEWS) * TREES * TREE_ROWS
    number = F.when(F.col("good") == 1, F.col("before_good")).otherwise(total.well + F.col("before_rows") - F.col("before_good"))
    rows = numbered.withColumn("number", number).join(F.broadcast(spark.createDataFrame(pa.table({"number": asked}))), "number").select("number", *FEATURES).toPandas().sort_values("number")
    values = rows[list(FEATURES)].to_numpy(float)
    return [IsolationForest.of([values[np.searchsorted(asked, d)][:, view] for d in ds], seed + k) for k, (view, ds) in enumerate(zip(VIEWS, drawn, strict=True))]


def _scorer(forests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(batch.schema.names.index(f)).to_numpy() for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            scores = [pa.array(forest.scores(rows[:, view])) for view, forest in zip(VIEWS, forests.value, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(1, 1 + len(COUNTS))), *scores], names=["row_id", *COUNTS, *SCORES])

    return run


def _counter(cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each view and number of cuts below a score: the scores with it, and the least of them."""
        n, least = ([np.full(len(c) + 1, v) for c in cuts.value] for v in (0, np.inf))
        for batch in batches:
            for k, c in enumerate(cuts.value):
                score = batch.column(k).to_numpy()
                place = np.searchsorted(c, score, "left")
                np.add.at(n[k], place, 1)
                np.minimum.at(least[k], place, score)
        for k in range(len(n)):
            some = np.flatnonzero(n[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[k][some]), pa.array(least[k][some])], names=["view", "place", "n", "least"])

    return run


def _thresholds(marks: DataFrame) -> list[float]:
    """``_threshold`` for each view, of all rows (good 0 or 1, scores), at least one of them good.

    The best cut is the score of a good row: a cut between two of them loses as many good rows as the lower
    one and catches no more. So the driver needs the good rows' highest scores, a share of ``MAX_LOSS``,
    and how many of the others lie between them.
    """
    spark = marks.sparkSession
    count = marks.groupBy("good").count().collect()
    well, ill = (sum(r["count"] for r in count if r.good == g) for g in (1, 0))
    few = well - max(0, int(np.ceil(well * (1 - MAX_LOSS))) - 1)
    tails = [marks.filter("good = 1").select(F.lit(k).alias("view"), F.col(s).alias("score")).orderBy(F.desc("score")).limit(few) for k, s in enumerate(SCORES)]
    high = reduce(DataFrame.union, tails).toPandas()
    fine = [np.sort(high["score"][high["view"] == k].to_numpy()) for k in range(len(SCORES))]
    cuts = [np.unique(f) for f in fine]
    placed = marks.filter("good = 0").select(*SCORES).mapInArrow(_counter(spark.sparkContext.broadcast(cuts)), "view int, place long, n long, least double")
    found = placed.groupBy("view", "place").agg(F.sum("n").alias("n"), F.min("least").alias("least")).toPandas()
    out = []
    for k, (f, c) in enumerate(zip(fine, cuts, strict=True)):
        mine = found[found["view"] == k]
        n, least = np.zeros(len(c) + 1, np.int64), np.full(len(c) + 1, np.inf)
        n[mine["place"]], least[mine["place"]] = mine["n"], mine["least"]
        caught = n[::-1].cumsum()[::-1][1:]
        lost = len(f) - np.searchsorted(f, c, "right")
        best = int(np.argmax(caught / max(ill, 1) - lost / well))
        above = min([*c[best + 1 : best + 2], *least[best + 1 :]])
        out.append(float((c[best] + above) / 2) if np.isfinite(above) else 1.0)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rule statistics of every whole text, base limits, and the forest's verdict.

    Base: fewer than 10 words, or more than 20% of the words in 5-word runs that the text
    repeats, fails. Others are kept unless the score of a forest exceeds its threshold,
    calibrated on all labelled rows (``anomaly`` above 0). Each tree draws its rows from all labelled ones. To the
    driver come the rows that trees drew, as numbers, and the highest scores of good rows, a share of ``MAX_LOSS``.

    A null text has no words and fails the base limit; null ids and repeated rows are rows
    of their own and join no label; without good labels nothing but the base limits
    rejects. Other columns are ignored. Returns id, the counts, base_failed, anomaly, kept.
    """
    spark = docs.sparkSession
    ddl = docs.select(F.col(id_col).alias("row_id")).schema.fields[0].dataType.simpleString()
    schema = ", ".join([f"row_id {ddl}", *(f"{c} long" for c in COUNTS), *(f"{f} double" for f in FEATURES)])
    stats = stored(docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_stats, schema), "quality")
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(label_col).alias("good"))
    good = (F.col("good").cast("double") > 0).cast("long").alias("good")
    worded = F.col("n_words") >= MIN_WORDS
    forests = _forests(stats.filter(worded).join(marked, "row_id").select("row_id", good, *FEATURES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    if forests is None:
        scored = stats.withColumn("anomaly", F.lit(0.0))
    else:
        shared = spark.sparkContext.broadcast(forests)  # trees of at most 2 * TREE_ROWS nodes
        scored = stored(stats.mapInArrow(_scorer(shared), ", ".join([f"row_id {ddl}", *(f"{c} long" for c in COUNTS), *(f"{s} double" for s in SCORES)])), "quality")
        bounds = _thresholds(stored(scored.filter(worded).join(marked, "row_id").select(good, *SCORES), "quality"))
        scored = scored.withColumn("anomaly", F.greatest(*(F.col(s) - bound for s, bound in zip(SCORES, bounds, strict=True))))
    scored = scored.withColumn("base_failed", failed)
    return scored.select(F.col("row_id").alias(id_col), *COUNTS, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") <= 0)).alias("kept"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
