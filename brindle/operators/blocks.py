"""Searches for a stated set of queries: blocks of queries meet all rows in an Arrow kernel that keeps k rows a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of one task's job, and those whose distances stand in memory at once.
BLOCK, STEP = 1000, 64


def _least(table: pa.Table, k: int, names: list[str]) -> pa.Table:
    """The first k rows of each query by distance, then by the kept columns."""
    table = table.sort_by([("asked", "ascending"), ("distance", "ascending"), *((n, "ascending") for n in names)])
    asked = table["asked"].to_numpy()
    first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, np.int64)
    rank = np.arange(len(asked)) - np.repeat(first, np.diff(np.r_[first, len(asked)]))
    return table.filter(pa.array(rank < k))


def _kernel(ids: list, kind: pa.DataType, values: np.ndarray, k: int, names: list[str], measure: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = pa.Table.from_batches([batch]).select(names)
            for begin in range(0, len(ids), STEP):
                d = measure(batch, values[begin : begin + STEP])
                near = ~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k]) if batch.num_rows > k else np.ones(d.shape, bool)
                asked, row = np.nonzero(near)
                best.append(kept.take(pa.array(row)).append_column("distance", pa.array(d[asked, row])).append_column("asked", pa.array(asked + begin)))
            best = [_least(pa.concat_tables(best), k, names)]
        for table in best:
            named = pa.array(ids, kind).take(table["asked"].combine_chunks())
            yield from table.drop_columns("asked").add_column(0, "query_id", named).combine_chunks().to_batches()

    return run


def nearest_in_blocks(rows: DataFrame, kept: int, queries: DataFrame, k: int, measure: Callable, block: int = BLOCK) -> DataFrame:
    """(query_id, the first ``kept`` columns of rows, distance, rank): the k rows of least distance for each query.

    ``queries`` has an id and then numbers, or one array of them; ``measure`` gives the
    (queries, rows) distances of a batch. Equal distances go by the kept columns in their
    order. A task keeps k rows for each query, so what is shuffled is k times tasks times
    queries. Without queries or rows the result is empty.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    columns, inner = rows.columns, [f"c{i}" for i in range(len(rows.columns))]
    names, moved = inner[:kept], rows.toDF(*inner)
    asked = queries.schema.fields[0].dataType
    schema = T.StructType([T.StructField("query_id", asked), *(moved.schema[n] for n in names), T.StructField("distance", T.DoubleType())])
    out, part = None, []

    def answer(part: list) -> DataFrame:
        values = np.array([p[1] if len(p) == 2 and isinstance(p[1], list) else p[1:] for p in part], np.float64)
        found = moved.mapInArrow(_kernel([p[0] for p in part], to_arrow_type(asked), values, k, names, measure), schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", *names))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    for q in queries.toLocalIterator():
        part.append(tuple(q))
        if len(part) == block:
            out, part = (answer(part) if out is None else out.unionByName(answer(part))), []
    if part:
        out = answer(part) if out is None else out.unionByName(answer(part))
    if out is None:
        out = rows.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    return out.toDF("query_id", *columns[:kept], "distance", "rank")
