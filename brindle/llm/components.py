"""Connected components of links by hooking and contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, stored


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for all ends of the links (a, b); the root is the component's least vertex.

    Every round each vertex hooks to its least neighbour if that is smaller, hooks are
    followed until they end (twice as far each time, so a chain of n takes about log n
    steps), and links are drawn anew between the ends. Rounds after the first see only what
    is still linked; their hooks are put together at the end. Minima are partial
    aggregates, so a vertex with very many links is no bottleneck; each step is written to
    the shared folder, which cuts its lineage. Null ends are no vertices.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    rest = stored(links.filter("a <> b").select(*ordered("a", "b")).distinct(), "links")
    # a link of a vertex with itself makes it a vertex, too
    alone = links.filter("a = b").select(F.col("a").alias("x"), F.col("a").alias("to"))
    rounds = []
    while not rest.isEmpty():
        # the lesser end of a link has no smaller neighbour by it
        hook = cut(rest.select("a", "b").union(rest.select("a", "a")).groupBy(F.col("b").alias("x")).agg(F.min("a").alias("to")))
        while True:
            far = hook.select(F.col("x").alias("to"), F.col("to").alias("far"))
            hook = cut(hook.join(far, "to").select("x", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moved")))
            if hook.filter("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.drop("moved")
        rounds.append(hook)
        left, right = hook.toDF("a", "a2"), hook.toDF("b", "b2")
        rest = stored(rest.join(left, "a").join(right, "b").filter("a2 <> b2").select(*ordered("a2", "b2")).distinct(), "links")
    roots = None
    for hook in reversed(rounds):
        if roots is not None:
            hook = hook.join(roots.toDF("to", "root"), "to", "left").select("x", F.coalesce("root", "to").alias("to"))
        roots = hook
    roots = alone.distinct() if roots is None else roots.union(alone.join(roots, "x", "left_anti").distinct())
    return cut(roots.select(F.col("x").alias("vertex"), F.col("to").alias("root")))
