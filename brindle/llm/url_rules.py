"""Operator 8: URL rules by a sort-merge sweep over reversed-host keys, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, partitions

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, then up to ``? #``; both empty without one."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind: all hosts under a domain begin with its key."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Canonical rules (host, path, verdict); of rules for the same host and path block wins."""
    for host, _, verdict in rules:
        if not host or any(c in host for c in "/?#") or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {(host, verdict)}")
    table = spark.createDataFrame(list(rules) or [("", "", "")], "host string, path string, verdict string").filter("host <> ''")
    table = table.withColumn("host", F.translate("host", _UPPER, _LOWER))
    return table.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _stacks(keys: DataFrame) -> DataFrame:
    """For each key the stack of keys open at its start: itself and all its prefixes among the keys, shortest first."""
    opens = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("open"))
    known = keys.select(F.col("key").alias("open"))
    return opens.join(known, "open").groupBy("key").agg(F.array_sort(F.collect_set("open")).alias("stack"))


def sweep(points: DataFrame, keys: DataFrame, key: str, tie: str) -> DataFrame:
    """Add ``active``: the nested keys (intervals of all strings that begin with them) open at each point.

    Points and keys are dealt out together by range of (key, kind, tie), so equal points
    spread over tasks. A sweep over each range keeps the stack of the last key that
    opened; the stack on entry to a range is the last one opened in an earlier range
    (one row a range). Of that stack the intervals that still hold the point stay.
    """
    n = partitions(points.sparkSession)
    kept = [c for c in points.columns if c != key]
    stacks = _stacks(keys)
    rows = stacks.select(F.col("key").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "stack", F.lit(None).cast(points.select(F.struct(*kept)).schema[0].dataType).alias("point"))
    rows = rows.unionByName(points.select(F.col(key).alias("at"), F.lit(1).alias("kind"), F.xxhash64(tie).alias("tie"), F.lit(None).cast("array<string>").alias("stack"), F.struct(*kept).alias("point")))
    order = ["at", "kind", "tie"]
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    from pyspark.sql import Window

    last = ranged.filter("kind = 0").groupBy("range").agg(F.max_by("stack", "at").alias("stack"))
    ranges = ranged.groupBy("range").count().select("range").join(last, "range", "left")  # one row a range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    entry = ranges.select("range", F.last("stack", ignorenulls=True).over(before).alias("stack"))
    entry = entry.filter("stack is not null").select(F.lit("").alias("at"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("tie"), "stack", F.lit(None).cast(ranged.schema["point"].dataType).alias("point"), "range")
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.unionByName(entry).withColumn("top", F.last("stack", ignorenulls=True).over(running)).filter("kind = 1")
    active = F.coalesce(F.filter("top", lambda s: F.startswith(F.col("at"), s)), F.array().cast("array<string>"))
    return swept.select(F.col("at").alias(key), "point.*", active.alias("active"))


def judge_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    default: str = DEFAULT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every URL by the longest rule that fits it; ``default`` where none does.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path.
    The longest rule (host and path together, then host) wins; of two verdicts on one rule
    block wins. A first sweep over reversed-host keys finds the rule hosts open at each
    URL, a second one over (rule host, path) keys the rules of those hosts that hold it.

    A null url, or one without ``://``, has an empty host and path, which no rule fits.
    Rows are kept one for one, repeated rows and null ids too; other columns are ignored;
    an empty table gives an empty result. Returns id, host, path, rule, verdict.
    """
    spark = df.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    table = cut(table.select("host", "path", "verdict", host_key(F.col("host")).alias("host_key")))
    host, path = url_parts(F.col(url_col))
    urls = df.select(F.col(id_col).alias("row_id"), host.alias("host"), path.alias("path")).withColumn("row_no", F.monotonically_increasing_id())
    hosts = sweep(urls.withColumn("key", host_key(F.col("host"))), table.select(F.col("host_key").alias("key")).distinct(), "key", "row_no")
    hosts = cut(hosts.drop("key"))
    slash = F.lit("/")
    pairs = hosts.select("row_no", F.explode("active").alias("open"), "path").withColumn("key", F.concat("open", slash, "path")).drop("open", "path")
    keyed = table.withColumn("key", F.concat("host_key", slash, "path"))
    fits = sweep(pairs, keyed.select("key"), "key", "row_no").select("row_no", F.explode("active").alias("key"))
    text = F.concat("host", "path")
    rank = keyed.select("key", F.struct(F.length(text).alias("a"), F.length("host").alias("b"), text.alias("rule"), "verdict").alias("best"))
    best = fits.join(rank, "key").groupBy("row_no").agg(F.max("best").alias("best"))
    joined = hosts.join(best, "row_no", "left")
    return joined.select(F.col("row_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
