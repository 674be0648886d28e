"""Operator 7: contiguous shards of balanced bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import global_prefix

OVERHEAD = 16


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Deal rows into ``shards`` contiguous runs of nearly equal bytes.

    Rows are ordered by (md5 of the text, id), so equal texts are neighbours. The bytes
    before each row are a global prefix sum built from one total per partition; shard k
    begins at the row boundary nearest to k/shards of all bytes. Where that boundary would
    part a group of equal texts that is no larger than the largest row, it moves to the
    nearer end of the group; larger groups are parted, so that sizes stay near equal.

    A null text counts as empty, null ids come first in their group, repeated rows are
    rows of their own; an empty table gives an empty result, and other columns are
    ignored. Returns id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).alias("row_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("digest"),
    )
    placed = global_prefix(rows, ["digest", "row_id"], ["size"])
    total, largest, count = placed.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).first()
    cuts = _cuts(spark, placed, total or 0, largest or 0, shards) if count else []
    shard = sum((F.when(F.col("before_size") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = dict(placed.groupBy("shard").agg(F.min("before_rows")).collect())  # one row a shard
    begin = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))[F.col("shard")] if first else F.lit(0)
    return placed.select(
        F.col("row_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before_rows") - begin).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(spark, placed: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Where shards 1, 2, ... begin, in bytes before the row. Collects a row per shard."""
    targets = [total * k // shards for k in range(1, shards)]
    if not targets:
        return []
    # target k lies before byte e exactly for k up to (e * shards - 1) div total
    upto = lambda e: F.expr(f"(({e}) * {shards}L - 1) div {total}L")
    edge = placed.filter(upto("before_size + size") > upto("before_size")).select("digest", "before_size", "size").collect()
    groups = {}
    if edge:
        keys = spark.createDataFrame([(d,) for d in sorted({r[0] for r in edge})], "digest string")
        near = placed.join(F.broadcast(keys), "digest").groupBy("digest").agg(F.min("before_size"), F.sum("size"))
        groups = {d: (a, b) for d, a, b in near.collect()}
    cuts = []
    for t in targets:
        row = next((r for r in edge if r[1] <= t < r[1] + r[2]), None)
        if row is None:
            cuts.append(t)
            continue
        begin, size = groups[row[0]]
        lo, hi = (begin, begin + size) if size <= largest else (row[1], row[1] + row[2])
        cuts.append(lo if t - lo <= hi - t else hi)
    return cuts


def op7_shards(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
