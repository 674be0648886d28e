"""Operator 3: a time-varying curriculum that mixes sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, global_prefix, partitions

#: Words of the contract: runs without blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: (time, factor) knots of the schedules that sources follow in turn: an early, a steady and a late one.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def cycle_weights(docs: DataFrame, cycle: Sequence[int] = (5, 2, 1), source_col: str = "source") -> DataFrame:
    """(source, place, weight): distinct sources by code point, null last, weigh the cycle in turn."""
    names = docs.select(F.col(source_col).alias("source")).distinct().withColumn("missing", F.col("source").isNull().cast("int"))
    placed = global_prefix(names.withColumn("one", F.lit(1).cast("long")), ["missing", "source"], ["one"])
    weight = F.element_at(F.array(*(F.lit(w) for w in cycle)), (F.col("before_one") % len(cycle) + 1).cast("int"))
    return placed.select("source", F.col("before_one").alias("place"), weight.cast("long").alias("weight"))


def fill_targets(sources: DataFrame, share: Fraction, cap: int) -> DataFrame:
    """Add ``target``: share of all sizes dealt by weight; none above cap times its source's size.

    The excess of capped sources is dealt again by weight until none is above. Each round
    is one aggregate over the sources; only sums reach the driver, and all are integers.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    level, capped = None, (0, 0)
    while True:
        # weight * level >= cap * size, in integers: weight * num >= cap * size * den
        over = F.lit(False) if level is None else F.expr(f"cast(weight as decimal(38,0)) * {level.numerator}BD >= cast(source_size as decimal(38,0)) * {cap * level.denominator}BD")
        full, rest, n = sources.agg(
            F.sum(F.when(over, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("int"))
        ).first()
        if not rest or (level is not None and (n, full) == capped):
            break
        capped = (n or 0, full or 0)
        level = Fraction(budget - (full or 0)) / rest
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share_of = F.col("weight") * F.lit(level.numerator).cast("double") / F.lit(level.denominator).cast("double")
    return sources.withColumn("target", F.least(share_of, (F.col("source_size") * cap).cast("double")))


def _inverse(fraction, knots: Sequence[tuple[float, float]]):
    """Time at which the integral of the piecewise linear schedule reaches this fraction of the whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        pieces.append((done / whole, (done + area) / whole, t0, t1, w0, w1, done))
        done += area
    for lo, hi, t0, t1, w0, w1, before in reversed(pieces):
        need = F.greatest(fraction * whole - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + need * (2 * slope), F.lit(0.0)))
        step = need * 2 / (F.lit(w0) + root)  # the stable root of w0 * x + slope * x * x / 2 = need
        out = F.when(fraction < F.lit(hi), F.lit(t0) + step).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: Fraction = Fraction(3, 2),
    cap: int = 2,
    schedules=SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Say how often, and when, the mix takes each document.

    Within its source documents stand in the order of md5(id), which does not depend on
    partitions; the source is passed over as often as its target asks (up to ``cap``
    times). A copy is taken if its middle word comes before the target, so each source's
    words differ from the target by half a document at most, and a document is never
    taken more than ``cap`` times. Source k follows schedule k mod len(schedules): its
    demand up to time t is its target times the integral of the schedule to t, and
    a copy's training position is the time at which that demand reaches its middle word.

    Null text: size 0, taken 0. A null source is a source of its own; a null id sorts
    first; equal ids are separate rows in the order of their texts' md5. An empty table gives
    an empty result. Returns id, size, source_size, target, taken, copies, position
    (of the first copy, 0 to 1; null if none), positions (of all copies), then the columns of ``keep`` as kept_<name>.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("row_id"),
        F.col(source_col).alias("source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("shuffle_key"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_key"),
        size.alias("size"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
    )
    placed = global_prefix(rows, ["source", "shuffle_key", "row_id", "text_key"], ["size"], wide=bool(keep))
    if weights is None:
        weights = cycle_weights(placed)
    totals = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("source_begin"))
    sources = cut(totals.join(weights, totals["source"].eqNullSafe(weights["source"])).drop(weights["source"]))
    sources = fill_targets(sources, share, cap)
    s = sources.withColumnRenamed("source", "source_name")
    joined = placed.join(s, placed["source"].eqNullSafe(s["source_name"]))
    begin = F.col("before_size") - F.col("source_begin")
    middle = [begin + F.col("source_size") * k + F.col("size") / 2 for k in range(cap)]
    copies = sum((F.when((F.col("size") > 0) & (m < F.col("target")), 1).otherwise(0) for m in middle), F.lit(0))
    at = lambda m: F.when(F.col("target") > 0, m / F.col("target"))
    times = F.array(*(F.coalesce(*(F.when(F.col("place") % len(schedules) == k, _inverse(at(m), knots)) for k, knots in enumerate(schedules))) for m in middle))
    return joined.select(
        F.col("row_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
        F.when(copies > 0, times[0]).alias("position"),
        F.slice(times, F.lit(1), copies.cast("int")).alias("positions"),
        *(F.col(f"kept_{c}") for c in keep),
    )


def order_mix(plan: DataFrame, id_col: str = "doc_id", position_col: str = "position") -> DataFrame:
    """Range-sort by training position: partition k precedes partition k + 1, and within one rows ascend.

    Documents without a position come last; a hash of the id deals them and ties out over partitions.
    """
    order = [F.col(position_col).asc_nulls_last(), F.xxhash64(id_col)]
    return plan.repartitionByRange(partitions(plan.sparkSession), *order).sortWithinPartitions(*order)


def op3_mix(spark, sf_dir: str) -> DataFrame:
    plan = order_mix(plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return plan.withColumn("target", F.round("target", 6)).withColumn("position", F.round("position", 9)).drop("positions")
