"""Shared folders, checkpoints, ranged prefix sums and file access for the corpus operators.

Everything that outlives a task goes to the folder named by ``spark.checkpoint.dir``.
Only where that setting is absent on one machine (tests, notebooks) is a temporary
folder made; a cluster without it is an error.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; made only if none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def unused(name: str, columns: Sequence[str]) -> str:
    """The name, with underscores if a column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared folder. Nothing is created yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:") :]
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Keep Arrow batches of this session at some MB: the default of 64 MB for each task is much for workers with texts.

    It stays set, since a DataFrame that is returned runs later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it back (column pruning, compression)."""
    path = new_folder(df.sparkSession, kind)
    bound_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file URI; works on drivers and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, whose worker gives freed memory back to the system when a task ends, since it waits for others beside the JVM."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return tidied


def _running(sizes: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, row = dict.fromkeys(sizes, 0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, names = list(batch.columns), list(batch.schema.names)
            for s in sizes:
                values = batch.column(names.index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(values)
                columns.append(pa.array(total - values + before[s]))
                names.append(f"before_{s}")
                before[s] += int(total[-1])
            columns.append(pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64)))
            names.append("before_rows")
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def global_prefix(df: DataFrame, order: Sequence[str], sizes: Sequence[str], n: int | None = None, wide: bool = False) -> DataFrame:
    """Add ``before_<size>`` for each size and ``before_rows``: sums over all rows that come earlier.

    Rows are dealt out by range, so equal leading keys spread over tasks as soon as a later
    key differs. Each task sums its own rows; what crosses to the driver is one total for
    each partition (their number is the configured one). Sizes must be non-null longs.
    The rows are stored before the range bounds are sampled, so that they are made once;
    ``wide`` rows (with texts) are made twice instead, which takes less disk.
    """
    spark = df.sparkSession
    df = df if wide else stored(df, "rows")
    n = n or partitions(spark)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("prefix_part", F.spark_partition_id())
    extra = [T.StructField(f"before_{s}", T.LongType()) for s in sizes] + [T.StructField("before_rows", T.LongType())]
    local = stored(ranged.mapInArrow(lean(_running(sizes)), T.StructType(ranged.schema.fields + extra)), "prefix")
    totals = local.groupBy("prefix_part").agg(*(F.sum(s).alias(f"t_{s}") for s in sizes), F.count(F.lit(1)).alias("t_rows")).collect()
    base, sums = [], [0] * (len(sizes) + 1)
    for t in sorted(totals):
        base.append((t[0], *sums))
        sums = [a + int(b) for a, b in zip(sums, t[1:], strict=True)]
    names = [*sizes, "rows"]
    schema = T.StructType([T.StructField("prefix_part", T.IntegerType())] + [T.StructField(f"base_{x}", T.LongType()) for x in names])
    joined = local.join(F.broadcast(spark.createDataFrame(base, schema)), "prefix_part")
    for x in names:
        joined = joined.withColumn(f"before_{x}", F.col(f"before_{x}") + F.col(f"base_{x}")).drop(f"base_{x}")
    return joined.drop("prefix_part")
