"""Registered queries of the library and the SQL that gives the same rows.

Scores are rounded on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import spatial as sf
from brindle.functions.analyzer import analyzer, native_analyzer
from brindle.functions.vectors import score
from brindle.operators import bow, spatial
from brindle.operators.relational import aggregate_column, group_aggregate, hash_join, ordered, two_valued
from brindle.operators.text import TextIndex, precision_recall, scan_bm25
from brindle.operators.vector import IVFIndex, graph_top_k, top_k, top_k_batch
from brindle.plans.dialect import Database
from brindle.plugins import PluginRegistry
from brindle.streaming.index_maintenance import windowed_events
from brindle.tables import deleted, inserted, load, updated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEARCH = "the and tion ing onre the"
POLYGON = ((-100.0, -50.0), (80.0, -40.0), (60.0, 55.0), (-20.0, 10.0), (-90.0, 60.0))  # (x, y)

_POINTS = "select c_custkey, cast(c_custkey * 7919 % 36000 as double) / 100 - 180 as x, cast(c_custkey * 104729 % 18000 as double) / 100 - 90 as y from customer"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_Q0 = "(select embedding::double[] as q from embeddings where vec_id = 0)"


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers at made-up coordinates that any SQL engine computes alike."""
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", ((k * 7919 % 36000).cast("double") / 100 - 180).alias("x"), ((k * 104729 % 18000).cast("double") / 100 - 90).alias("y"))


# relational


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price from lineitem where l_quantity between 1 and 25 group by all having count(*) > 0")
def scan_filter_between(spark, d):
    df = load(spark, d, "lineitem").filter(F.col("l_quantity").between(1, 25))
    out = group_aggregate(df, ["l_returnflag", "l_linestatus"], {"n": ("count", None), "sum_qty": ("sum", "l_quantity"), "avg_price": ("avg", "l_extendedprice")}, F.col("n") > 0)
    return out.withColumn("sum_qty", F.round("sum_qty", 2)).withColumn("avg_price", F.round("avg_price", 4))


@query("select p_partkey, p_name, p_size from part where p_size in (1, 5, 9, 14) and p_type like '%STEEL%' or p_brand like 'Brand#1_'")
def filter_in_like(spark, d):
    return load(spark, d, "part").filter((F.col("p_size").isin(1, 5, 9, 14) & F.col("p_type").like("%STEEL%")) | F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_name", "p_size")


@query("select o_orderkey, o_orderstatus from orders where not (o_orderstatus = 'F' or o_totalprice < 100000)")
def filter_not_or(spark, d):
    return load(spark, d, "orders").filter(~((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 100000))).select("o_orderkey", "o_orderstatus")


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, l_orderkey % 7 as slot, l_quantity + 1 as more from lineitem where l_orderkey = 7 or l_orderkey between 100 and 200")
def project_alias_arith(spark, d):
    df = load(spark, d, "lineitem").filter((F.col("l_orderkey") == 7) | F.col("l_orderkey").between(100, 200))
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), (F.col("l_orderkey") % 7).alias("slot"), (F.col("l_quantity") + 1).alias("more"))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_pairs(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5")
def order_limit_offset(spark, d):
    return ordered(load(spark, d, "orders"), [("o_totalprice", False), ("o_orderkey", True)], 20, 5).select("o_orderkey", "o_totalprice")


@query("select count(*) as n, round(sum(l_quantity), 2) as s, round(avg(l_quantity), 6) as a, min(l_shipdate) as lo, max(l_comment) as hi from (select *, l_returnflag || l_linestatus as l_comment from lineitem)")
def agg_global(spark, d):
    df = load(spark, d, "lineitem").withColumn("l_comment", F.concat("l_returnflag", "l_linestatus"))
    out = group_aggregate(df, [], {"n": ("count", None), "s": ("sum", "l_quantity"), "a": ("avg", "l_quantity"), "lo": ("min", "l_shipdate"), "hi": ("max", "l_comment")})
    return out.withColumn("s", F.round("s", 2)).withColumn("a", F.round("a", 6))


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(max(o_totalprice), 2) as top from orders group by all")
def agg_group_multi(spark, d):
    return group_aggregate(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": ("count", None), "top": ("max", "o_totalprice")}).withColumn("top", F.round("top", 2))


@query("select l_returnflag, count(distinct l_suppkey) as suppliers, sum(distinct l_linenumber)::bigint as lines, round(avg(distinct l_quantity), 6) as qty, min(distinct l_partkey) as lo from lineitem group by 1")
def agg_distinct(spark, d):
    df = load(spark, d, "lineitem").groupBy("l_returnflag").agg(
        aggregate_column("count", F.col("l_suppkey"), True).alias("suppliers"), aggregate_column("sum", F.col("l_linenumber"), True).alias("lines"), aggregate_column("avg", F.col("l_quantity"), True).alias("qty"), aggregate_column("min", F.col("l_partkey"), True).alias("lo")
    )
    return df.withColumn("qty", F.round("qty", 6))


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 12")
def having_count(spark, d):
    return group_aggregate(load(spark, d, "orders"), ["o_custkey"], {"n": ("count", None)}, F.col("n") > 12)


@query("select count(*) as n, coalesce(sum(o_custkey), 0)::bigint as s from orders where o_orderkey < 0")
def agg_empty_input(spark, d):
    return load(spark, d, "orders").filter("o_orderkey < 0").agg(aggregate_column("count", None).alias("n"), aggregate_column("sum", F.col("o_custkey"), empty_sum_zero=True).cast("long").alias("s"))


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def join_inner_equi(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("select r_name, count(*) as n, round(sum(o_totalprice), 0) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def join_chain3(spark, d):
    df = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    a, b = (load(spark, d, "nation").select(*(F.col(c).alias(f"{p}_{c}") for c in ("n_nationkey", "n_name", "n_regionkey"))) for p in "ab")
    return a.join(b, (F.col("a_n_regionkey") == F.col("b_n_regionkey")) & (F.col("a_n_nationkey") < F.col("b_n_nationkey"))).select(F.col("a_n_name").alias("a"), F.col("b_n_name").alias("b"))


@query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey where o_totalprice > 200000")
def join_partitioned_hash(spark, d):
    big = load(spark, d, "orders").filter("o_totalprice > 200000")
    return hash_join(load(spark, d, "lineitem"), big, "l_orderkey", "o_orderkey").select("o_orderkey", "l_linenumber", "l_quantity")


_NULLABLE = "(select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderpriority end as priority from orders)"


def _nullable(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("priority"))


@query(f"select priority is null as missing, count(*) as n, count(priority) as named from {_NULLABLE} group by 1")
def is_null_filter(spark, d):
    return _nullable(spark, d).groupBy(F.col("priority").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"), F.count("priority").alias("named"))


@query(f"select o_orderkey from {_NULLABLE} where not coalesce(priority = '1-URGENT', false)")
def two_valued_not(spark, d):
    return _nullable(spark, d).filter(~two_valued(F.col("priority") == "1-URGENT")).select("o_orderkey")


@query(f"select priority, count(*) as n from {_NULLABLE} group by 1 order by priority nulls last")
def order_nulls_last(spark, d):
    return ordered(_nullable(spark, d).groupBy("priority").agg(F.count(F.lit(1)).alias("n")), [("priority", True)])


@query("select s_suppkey, s_acctbal from supplier union all select 1000000 + s_suppkey, 0.5 from supplier where s_suppkey < 10")
def dml_insert(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return inserted(s, s.filter("s_suppkey < 10").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit(0.5).alias("s_acctbal")))


@query(f"select o_orderkey, priority from {_NULLABLE} where not coalesce(priority like '1%', false)")
def dml_delete(spark, d):
    return deleted(_nullable(spark, d), F.col("priority").like("1%"))


@query(f"select o_orderkey, case when priority is null then 'none' when o_orderkey < 100 then priority || '!' else priority end as priority from {_NULLABLE}")
def dml_update(spark, d):
    once = updated(_nullable(spark, d), {"priority": F.concat("priority", F.lit("!"))}, F.col("o_orderkey") < 100)
    return updated(once, {"priority": F.lit("none")}, F.col("priority").isNull())


@query("select event_type, count(*) as n, min(ts) as first_ts, round(max(value), 6) as top from events where ts >= timestamp '1970-01-01' group by 1")
def events_by_type(spark, d):
    return load(spark, d, "events").filter(F.col("ts") >= F.lit("1970-01-01").cast("timestamp")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.round(F.max("value"), 6).alias("top"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_windowed(spark, d):
    return windowed_events(load(spark, d, "events")).withColumn("total", F.round("total", 4))


# spatial

_HAVERSINE = "2 * {r} * asin(sqrt(greatest(0.0, least(1.0, pow(sin((radians({y}) - radians(y)) / 2), 2) + cos(radians(y)) * cos(radians({y})) * pow(sin(radians({x} - x) / 2), 2)))))"


@query(f"select c_custkey, round(sqrt((x - 10.0) * (x - 10.0) + (y - 20.0) * (y - 20.0)), 6) as dist from ({_POINTS})")
def spatial_distance_euclid(spark, d):
    return points(spark, d).select("c_custkey", F.round(sf.distance(F.col("x"), F.col("y"), 10.0, 20.0), 6).alias("dist"))


@query(f"select c_custkey, round({_HAVERSINE.format(r='6371008.8', x='10.0', y='20.0')}, 3) as dist from ({_POINTS})")
def spatial_distance_haversine(spark, d):
    return points(spark, d).select("c_custkey", F.round(sf.distance(F.col("x"), F.col("y"), 10.0, 20.0, "haversine"), 3).alias("dist"))


@query(f"select c_custkey, round(sqrt((x + 30.0) * (x + 30.0) + (y - 5.0) * (y - 5.0)), 6) as dist from ({_POINTS}) where sqrt((x + 30.0) * (x + 30.0) + (y - 5.0) * (y - 5.0)) <= 25.0")
def spatial_radius(spark, d):
    return spatial.radius_search(points(spark, d), -30.0, 5.0, 25.0).select("c_custkey", F.round("distance", 6).alias("dist"))


@query(f"select c_custkey, round({_HAVERSINE.format(r='6371000.0', x='170.0', y='60.0')}, 3) as dist from ({_POINTS}) where {_HAVERSINE.format(r='6371000.0', x='170.0', y='60.0')} <= 2500000.0")
def spatial_radius_haversine(spark, d):
    return spatial.radius_search(points(spark, d), 170.0, 60.0, 2_500_000.0, "haversine").select("c_custkey", F.round("distance", 3).alias("dist"))


@query(f"select c_custkey, x, y from ({_POINTS}) where x >= -50 and x <= 60.5 and y >= -10 and y <= 45.25")
def spatial_box(spark, d):
    return spatial.box_search(points(spark, d), (-50.0, -10.0, 60.5, 45.25))


def _polygon_sql() -> str:
    corners = list(POLYGON)
    edges = list(zip(corners, corners[1:] + corners[:1], strict=True))
    crossings = " + ".join(f"case when ({a[1]}::double > y) <> ({b[1]}::double > y) and x < ({b[0]}::double - {a[0]}::double) * (y - {a[1]}::double) / ({b[1]}::double - {a[1]}::double) + {a[0]}::double then 1 else 0 end" for a, b in edges)
    on_edge = " or ".join(f"((({b[0]}::double - {a[0]}::double) * (y - {a[1]}::double) - ({b[1]}::double - {a[1]}::double) * (x - {a[0]}::double)) = 0 and x between {min(a[0], b[0])} and {max(a[0], b[0])} and y between {min(a[1], b[1])} and {max(a[1], b[1])})" for a, b in edges)
    return f"select c_custkey from ({_POINTS}) where ({crossings}) % 2 = 1 or {on_edge}"


@query(_polygon_sql())
def spatial_polygon(spark, d):
    return spatial.polygon_search(points(spark, d), sf.Polygon(POLYGON)).select("c_custkey")


@query(f"select c_custkey, round(sqrt((x - 10.0) * (x - 10.0) + (y - 20.0) * (y - 20.0)), 6) as dist from ({_POINTS}) order by sqrt((x - 10.0) * (x - 10.0) + (y - 20.0) * (y - 20.0)), x, y, c_custkey limit 20")
def spatial_knn(spark, d):
    return spatial.knn(points(spark, d), 10.0, 20.0, 20, "c_custkey").select("c_custkey", F.round("distance", 6).alias("dist"))


@query(f"with p as ({_POINTS}), q as (select c_custkey as query_id, x as qx, y as qy from p where c_custkey % 20 = 0), r as (select query_id, c_custkey, round(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 6) as dist, row_number() over (partition by query_id order by sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), x, y, c_custkey)::int as rank from p, q) select * from r where rank <= 5")
def spatial_knn_batch(spark, d):
    p = points(spark, d)
    q = p.filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return spatial.knn_batch(p, q, 5, "c_custkey").select("query_id", "c_custkey", F.round("distance", 6).alias("dist"), "rank")


@query(f"with p as ({_POINTS}) select a.c_custkey as left_key, b.c_custkey as right_key, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as dist from p a join p b on a.c_custkey < b.c_custkey and a.x between b.x - 9 and b.x + 9 and a.y between b.y - 9 and b.y + 9 where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 9")
def spatial_within_join(spark, d):
    return spatial.within_pairs(points(spark, d), 9.0, "c_custkey", digits=6).withColumnRenamed("distance", "dist")


# text


def documents_index(spark, d) -> TextIndex:
    return TextIndex.build(load(spark, d, "documents"), "doc_id", "text")


def _terms(q: str) -> str:
    counts = {t: q.split().count(t) for t in q.split()}
    return "(values " + ", ".join(f"('{t}', {c}::double)" for t, c in counts.items()) + ") as q(term, qtf)"


_CORPUS = f"""docs as (select doc_id, {_TOKENS} as ts from documents where text is not null),
lens as (select doc_id, len(ts)::bigint as length from docs),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from docs) group by all),
dfs as (select term, count(*) as df from post group by 1),
tot as (select count(*)::double as n, avg(length) as avg_length from lens)"""
_BM25 = """bm as (select doc_id, sum(qtf * ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avg_length)))) as score
from post join dfs using (term) join {terms} using (term) join lens using (doc_id), tot group by 1)"""
_COSINE = """w as (select doc_id, term, tf * ln(n / df) as w, ln(n / df) as idf, tf from post join dfs using (term), tot),
qn as (select sqrt(sum(pow(qtf * ln(n / df), 2))) as q_norm from dfs join {terms} using (term), tot),
ns as (select doc_id, sqrt(sum(w * w)) as norm from w group by 1),
tfidf as (select doc_id, case when max(norm) > 0 and max(q_norm) > 0 then greatest(0, least(1, sum(qtf * w * idf) / (max(norm) * max(q_norm)))) else 0 end as score
from w join {terms} using (term) join ns using (doc_id), qn group by 1)"""


@query(f"with {_CORPUS} select * from post")
def text_postings(spark, d):
    return documents_index(spark, d).postings.select("doc_id", "term", "tf")


@query(f"with {_CORPUS} select term, df, round(ln(n / df), 6) as idf from dfs, tot")
def text_df_idf(spark, d):
    index = documents_index(spark, d)
    return index.terms.crossJoin(F.broadcast(index.totals())).select("term", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query(f"with {_CORPUS}, {_COSINE.format(terms=_terms(SEARCH))} select doc_id, round(score, 6) as score from tfidf order by tfidf.score desc, doc_id limit 10")
def text_tfidf_topk(spark, d):
    return documents_index(spark, d).match_top_k(SEARCH, 10, "tf_idf").withColumn("score", F.round("score", 6))


@query(f"with {_CORPUS}, {_BM25.format(terms=_terms(SEARCH))} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 10")
def text_bm25_topk(spark, d):
    return documents_index(spark, d).match_top_k(SEARCH, 10).withColumn("score", F.round("score", 6))


@query(f"with {_CORPUS}, {_BM25.format(terms=_terms(SEARCH))} select doc_id, lang, round(score, 6) as score from bm join documents using (doc_id) where lang = 'en' and doc_id > 20 order by bm.score desc, doc_id limit 15")
def text_bm25_filtered(spark, d):
    found = scan_bm25(load(spark, d, "documents"), "doc_id", "text", SEARCH)
    return found.filter("lang = 'en' and doc_id > 20").orderBy(F.desc("score"), "doc_id").limit(15).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(f"with {_CORPUS}, {_BM25.format(terms=_terms('onre'))} select doc_id, round(coalesce(score, 0), 6) as score from lens left join bm using (doc_id) order by coalesce(bm.score, 0) desc, doc_id limit 30")
def text_full_universe(spark, d):
    return documents_index(spark, d).top_k("onre", 30).withColumn("score", F.round("score", 6))


_BATCH = f"""with {_CORPUS}, q as (select item_id, term, count(*)::double as qtf from (select item_id, unnest({_TOKENS}) as term from benchmark where item_id % 20 = 0) group by all),
s as (select item_id, doc_id, sum(qtf * ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avg_length)))) as score
from post join q using (term) join dfs using (term) join lens using (doc_id), tot group by all),
r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from s)"""


def _batch(spark, d) -> DataFrame:
    return documents_index(spark, d).match_batch(load(spark, d, "benchmark").filter("item_id % 20 = 0"), 10, "item_id", "text")


@query(_BATCH + " select item_id, doc_id, rank::int as rank, round(score, 6) as score from r where rank <= 10")
def text_bm25_batch(spark, d):
    return _batch(spark, d).withColumn("score", F.round("score", 6))


@query(_BATCH + """, good as (select item_id, doc_id from (select distinct item_id from q), labels where quality = 1 and doc_id % 20 = item_id % 20)
select item_id, count(rank)::bigint as hits, count(rank) / 10.0::double as precision, case when count(*) filter (where g) > 0 then count(rank) / (count(*) filter (where g))::double end as recall
from (select item_id, doc_id, g, case when g then rank end as rank from (select item_id, doc_id, true as g from good) full join (select item_id, doc_id, rank from r where rank <= 10) using (item_id, doc_id)) group by 1""")
def text_precision_at_k(spark, d):
    ranked = _batch(spark, d)
    items = load(spark, d, "benchmark").filter("item_id % 20 = 0").select("item_id")
    good = load(spark, d, "labels").filter("quality = 1").withColumn("slot", F.col("doc_id") % 20).join(items.withColumn("slot", F.col("item_id") % 20), "slot").select("item_id", "doc_id")
    return precision_recall(ranked, good, 10, "item_id", "doc_id")


@query()
def text_analyzed_topk(spark, d):
    """BM25 behind the full analyzer (compatibility forms, case folding, stems), which SQL has no twin of."""
    index = TextIndex.build(load(spark, d, "documents"), "doc_id", "text", analyzer())
    return index.match_top_k("onre tions ering", 10).withColumn("score", F.round("score", 6))


# vectors

_DIST = "sqrt(list_sum(list_transform(list_zip(embedding::double[], q), p -> (p[1] - p[2]) * (p[1] - p[2]))))"


def _first_vector(spark, d, key: int = 0) -> list[float]:
    return list(load(spark, d, "embeddings").filter(F.col("vec_id") == key).first()["embedding"])


@query(f"select vec_id, round(1 / (1 + list_distance(embedding::double[], q)), 6) as score from embeddings, {_Q0} order by round(list_distance(embedding::double[], q), 9), vec_id limit 10")
def vec_exact_euclidean(spark, d):
    return top_k(load(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, {_Q0} order by round(list_cosine_similarity(embedding::double[], q), 9) desc, vec_id limit 10")
def vec_exact_cosine(spark, d):
    return top_k(load(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding", "cosine").withColumn("score", F.round("score", 6))


@query(f"select vec_id, round(list_inner_product(embedding::double[], q), 6) as score from embeddings, {_Q0} order by round(list_inner_product(embedding::double[], q), 9) desc, vec_id limit 10")
def vec_exact_ip(spark, d):
    return top_k(load(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding", "inner_product").withColumn("score", F.round("score", 6))


@query(f"select vec_id, round(1 / (1 + list_distance(embedding::double[], q)), 6) as score from embeddings, {_Q0} order by round(list_distance(embedding::double[], q), 9), vec_id limit 10")
def vec_graph_contract(spark, d):
    return graph_top_k(load(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), r as (select query_id, vec_id, list_cosine_similarity(embedding::double[], v) as s, row_number() over (partition by query_id order by round(list_cosine_similarity(embedding::double[], v), 9) desc, vec_id) as rank from embeddings, q) select query_id, vec_id, round(s, 6) as score, rank::int as rank from r where rank <= 5")
def vec_batch_topk(spark, d):
    e = load(spark, d, "embeddings")
    found = top_k_batch(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), 5, "vec_id", "embedding", "qid", "v", "cosine")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_CENTRES = "c as (select row_number() over (order by vec_id) - 1 as i, embedding::double[] as c from embeddings where vec_id < 16)"
_LISTS = f"{_CENTRES}, lists as (select vec_id, embedding, arg_min(i, (round(list_distance(embedding::double[], c), 9), i)) as list_id from embeddings, c group by vec_id, embedding)"


@query(f"with {_LISTS}, probe as (select i from c, {_Q0} order by round(list_distance(c, q), 9), i limit 4) select vec_id, round(1 / (1 + list_distance(embedding::double[], q)), 6) as score from lists, {_Q0} where list_id in (select i from probe) order by round(list_distance(embedding::double[], q), 9), vec_id limit 10")
def vec_ivf_fixed_centroids(spark, d):
    e = load(spark, d, "embeddings")
    centres = [list(r[0]) for r in e.filter("vec_id < 16").orderBy("vec_id").select("embedding").collect()]
    return IVFIndex.build(e, "vec_id", "embedding", centroids=centres).top_k(_first_vector(spark, d), 10, nprobe=4).withColumn("score", F.round("score", 6))


@query()
def vec_ivf_trained(spark, d):
    """Trained centroids depend on arithmetic order, so rows only."""
    index = IVFIndex.build(load(spark, d, "embeddings"), "vec_id", "embedding")
    return index.top_k(_first_vector(spark, d), 10, nprobe=index.enough(10, least=8))


@query(f"with {_LISTS}, qs as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0), probe as (select query_id, i, row_number() over (partition by query_id order by round(1 / (1 + list_distance(c, q)), 9) desc, i) as r from c, qs), exact as (select query_id, vec_id from (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(embedding::double[], q), 9), vec_id) as r from embeddings, qs) where r <= 10), got as (select r from exact join lists using (vec_id) join probe on probe.query_id = exact.query_id and i = list_id) select n::int as nprobe, round(count(*) filter (r <= n) / count(*), 6) as recall from got, range(1, 17) as t(n) group by n")
def vec_recall_at_k(spark, d):
    """Mean recall@10 by the number of lists probed: ids divisible by 20 against all rows."""
    e = load(spark, d, "embeddings")
    centres = [list(r[0]) for r in e.filter("vec_id < 16").orderBy("vec_id").select("embedding").collect()]
    recalls = IVFIndex.build(e, "vec_id", "embedding", centroids=centres).recalls(10)
    return spark.createDataFrame([(k + 1, round(float(r), 6)) for k, r in enumerate(recalls)], "nprobe int, recall double")


@query("select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, " + _Q0)
def vec_score_all(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(score(F.col("embedding"), F.array(*map(F.lit, _first_vector(spark, d))), "cosine"), 6).alias("score"))


@query(f"with {_CENTRES}, word as (select label, arg_min(i, (round(list_distance(embedding::double[], c), 9), i)) as word from (select vec_id, label, embedding from embeddings), c group by vec_id, label), h as (select label, word, count(*) as cnt from word group by all), idf as (select word, ln(((select count(distinct label) from h) + 1.0::double) / (count(*) + 1.0::double)) + 1 as idf from h group by 1), v as (select label, word, cnt * idf as w from h join idf using (word)) select label, word::int as word, round(w / sqrt(sum(w * w) over (partition by label)), 6) as weight from v")
def bow_histogram_tfidf(spark, d):
    e = load(spark, d, "embeddings")
    codebook = [list(r[0]) for r in e.filter("vec_id < 16").orderBy("vec_id").select("embedding").collect()]
    counts = bow.histograms(e, "label", "embedding", codebook)
    return bow.tfidf_vectors(counts, bow.smoothed_idf(counts, "label"), "label").withColumn("weight", F.round("weight", 6))


# the dialect


def database(spark, d, *names: str) -> Database:
    db = Database(spark)
    for n in names:
        db.store.attach(n, load(spark, d, n))
    return db


@query("select o_orderstatus, count(*) as n, round(max(o_totalprice), 2) as top from orders where o_orderkey between 10 and 5000 group by 1 having count(*) > 3 order by n desc limit 2")
def sql_select_group(spark, d):
    out = database(spark, d, "orders").execute("SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders WHERE o_orderkey BETWEEN 10 AND 5000 GROUP BY o_orderstatus HAVING COUNT(*) > 3 ORDER BY n DESC LIMIT 2")
    return out.withColumn("top", F.round("top", 2))


@query(f"select c_custkey, round(sqrt((x - 20.0) * (x - 20.0) + (y - 10.0) * (y - 10.0)), 6) as dist from ({_POINTS}) where x between -60 and 70 and y between -30 and 40 order by 2, 1 limit 12")
def sql_spatial(spark, d):
    db = Database(spark)
    db.store.attach("places", points(spark, d).select("c_custkey", F.struct("x", "y").alias("place")))
    out = db.execute("SELECT c_custkey, DISTANCE(place, POINT(10, 20)) AS dist FROM places WHERE INTERSECTS(place, POLYGON((-30, -60), (-30, 70), (40, 70), (40, -60))) ORDER BY DISTANCE(place, POINT(10, 20)), c_custkey LIMIT 12")
    return out.withColumn("dist", F.round("dist", 6))


@query(f"select c_nationkey, round(max(dist), 6) as far, count(*) as n from (select c_nationkey, sqrt((x - 20.0) * (x - 20.0) + (y - 10.0) * (y - 10.0)) as dist from ({_POINTS}) p join customer using (c_custkey)) where dist <= 60 group by 1")
def sql_radius(spark, d):
    db = Database(spark)
    places = points(spark, d).select("c_custkey", F.struct("x", "y").alias("place"))
    db.store.attach("places", places.join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey"))
    out = db.execute("SELECT c_nationkey, MAX(DISTANCE(place, POINT(10, 20))) AS far, COUNT(*) AS n FROM places WHERE DISTANCE(place, POINT(10, 20)) <= 60 GROUP BY c_nationkey")
    return out.withColumn("far", F.round("far", 6))


@query("select o_orderkey from orders where o_orderkey % 7 = 0 or not (o_orderpriority = '1-URGENT' or o_totalprice < 100000)")
def sql_not_null(spark, d):
    """NOT over a null: what is unknown does not hold."""
    db = Database(spark)
    db.store.attach("some", load(spark, d, "orders").withColumn("o_totalprice", F.expr("if(o_orderkey % 7 = 0, null, o_totalprice)")).withColumn("o_orderpriority", F.expr("if(o_orderkey % 7 = 0, null, o_orderpriority)")))
    return db.execute("SELECT o_orderkey FROM some WHERE NOT (o_orderpriority = '1-URGENT' OR o_totalprice < 100000)")


@query()
def sql_ranked_text(spark, d):
    db = database(spark, d, "documents")
    db.execute("CREATE INDEX by_text ON documents (text) USING INVERTED WITH (method = bm25)")
    return db.execute("SELECT doc_id, SCORE() AS s FROM documents WHERE MATCH(text, 'onre tion er') AND doc_id > 3 USING BM25 ORDER BY s DESC, doc_id LIMIT 10").withColumn("s", F.round("s", 6))


def _text_database(spark, d) -> Database:
    """Documents with an index over plain words, which SQL can count alike."""
    db = Database(spark, plugins=PluginRegistry.standard(native_analyzer()))
    db.store.attach("documents", load(spark, d, "documents"))
    db.execute("CREATE INDEX by_text ON documents (text) USING INVERTED")
    return db


@query(f"with {_CORPUS}, {_BM25.format(terms=_terms(SEARCH))} select doc_id, round(score, 6) as s from bm join documents using (doc_id) where lang = 'en' order by bm.score desc, doc_id limit 10")
def sql_search_bm25(spark, d):
    out = _text_database(spark, d).execute(f"SELECT doc_id, SCORE() AS s FROM documents WHERE MATCH(text, '{SEARCH}') AND lang = 'en' USING BM25 ORDER BY s DESC, doc_id LIMIT 10")
    return out.withColumn("s", F.round("s", 6))


@query(f"with {_CORPUS}, {_COSINE.format(terms=_terms(SEARCH))} select doc_id, round(score, 6) as s from tfidf order by tfidf.score desc, doc_id limit 10")
def sql_search_tfidf(spark, d):
    out = _text_database(spark, d).execute(f"SELECT doc_id, SCORE() AS s FROM documents WHERE SEARCH(text, '{SEARCH}') USING TF_IDF ORDER BY s DESC, doc_id LIMIT 10")
    return out.withColumn("s", F.round("s", 6))


@query(f"with {_CORPUS.replace('from documents', 'from (select * from documents where lang <> ' + chr(39) + 'en' + chr(39) + ')')}, {_BM25.format(terms=_terms(SEARCH))} select doc_id, round(score, 6) as s from bm order by bm.score desc, doc_id limit 10")
def sql_delete_then_search(spark, d):
    db = _text_database(spark, d)
    db.execute("DELETE FROM documents WHERE lang = 'en' OR lang IS NULL")
    out = db.execute(f"SELECT doc_id, SCORE() AS s FROM documents WHERE MATCH(text, '{SEARCH}') USING BM25 ORDER BY s DESC, doc_id LIMIT 10")
    return out.withColumn("s", F.round("s", 6))


class _Stored:
    """Vectors that are there already: a row's own, and one picked as reference."""

    def __init__(self, reference: list[float]) -> None:
        self.reference = reference

    def column(self, c):
        return c

    def one(self, reference):
        return self.reference


@query(f"select vec_id, round(1 / (1 + list_distance(embedding::double[], q)), 6) as s from embeddings, {_Q0} order by round(list_distance(embedding::double[], q), 9), vec_id limit 10")
def sql_similar_to(spark, d):
    db = database(spark, d, "embeddings")
    db.vectorizers["stored"] = _Stored(_first_vector(spark, d))
    db.execute("CREATE INDEX by_vector ON embeddings (embedding) USING HNSW WITH (metric = euclidean, profile = 'stored')")
    out = db.execute("SELECT vec_id, SIMILARITY_SCORE() AS s FROM embeddings WHERE SIMILAR_TO('first', k = 10) USING HNSW WITH METRIC = euclidean")
    return out.withColumn("s", F.round("s", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 10 over the documents."""
    return text_bm25_topk(spark, sf_dir)
