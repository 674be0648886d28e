"""Relational building blocks: naming rules, two-valued comparisons, grouped aggregates, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = ("count", "sum", "avg", "min", "max")


def two_valued(predicate: Column) -> Column:
    """A comparison that is false, not unknown, where an operand is null."""
    return F.coalesce(predicate, F.lit(False))


def aggregate_column(func: str, value: Column | None, distinct: bool = False, empty_sum_zero: bool = False) -> Column:
    """One of the five aggregates; ``empty_sum_zero`` makes SUM over nothing 0 instead of null."""
    func = func.lower()
    if func not in AGGREGATES:
        raise ValueError(f"{func} is none of {AGGREGATES}")
    if value is None:
        if func != "count" or distinct:
            raise ValueError("only COUNT takes *")
        return F.count(F.lit(1))
    if func == "count":
        return F.count_distinct(value) if distinct else F.count(value)
    if func in ("min", "max"):  # the same with or without DISTINCT
        return getattr(F, func)(value)
    made = F.sum_distinct(value) if func == "sum" and distinct else F.sum(value) if func == "sum" else F.avg(value)
    if func == "avg" and distinct:
        made = F.sum_distinct(value).cast("double") / F.count_distinct(value)
    return F.coalesce(made, F.lit(0)) if func == "sum" and empty_sum_zero else made


def output_name(alias: str | None, column: str | None, position: int) -> str:
    """Alias, else the source column, else column_<position>."""
    return alias or column or f"column_{position}"


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple], having: Column | None = None) -> DataFrame:
    """``aggregates``: output name to (function, column name or None[, distinct])."""
    made = [aggregate_column(f, None if c is None else F.col(c), *rest).alias(name) for name, (f, c, *rest) in aggregates.items()]
    out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out if having is None else out.filter(having)


def ordered(df: DataFrame, keys: Sequence[tuple[str | Column, bool]], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sort by (key, ascending), nulls last both ways; with a limit only the first rows move."""
    cols = [(F.col(k) if isinstance(k, str) else k, up) for k, up in keys]
    df = df.orderBy(*(c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in cols)) if cols else df
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join by partitioned hash tables; Spark picks another way where a side outgrows memory."""
    return left.join(right.hint("shuffle_hash"), left[left_key] == right[right_key])
