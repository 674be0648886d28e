from __future__ import annotations

import random

import pytest

from brindle.llm import url_rules as ur
from tests.compare import duck, spark_rows
from tests.llm.cases import clashing


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    for c in "?#":
        tail = tail.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail


def judge(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


def check(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ur.judge_urls(clashing(df), rules).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_contract_rules(spark):
    urls = [None, "", "no scheme", "http://", "://org/", "http://org", "http://ORG/x", "https://a.example.org/es/1", "https://aexample.org/es/1", "http://example.org/en/1", "http://example.org/en/2#/es/", "http://x.com?/fr/", "http://x.com/fr/?q", "http://com/de/", "ftp://u:p@example.org:80/es/", "http://a://b.org/", "http://é.ORG/Es/", "http://..org/", "http://x.org./"]
    check(spark, urls, ur.RULES)


def test_nested_rules_and_hot_hosts(spark):
    rng = random.Random(3)
    hosts = [".".join(rng.choice(["a", "b", "c", "org", "com"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "", "/ab", "/b"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/x', '?a', 'b/c/d'])}" for _ in range(600)] + ["http://a.b.org/a/b/c"] * 300
    check(spark, urls, rules)


def test_rows_stay_one_for_one(spark):
    df = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert sorted(((r.page_id, r.rule) for r in ur.judge_urls(df).collect()), key=repr) == sorted([(None, "org/"), (1, "org/"), (1, "org/"), (2, None)], key=repr)
    assert ur.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in ur.judge_urls(df, [], "block").collect()} == {"block"}
    assert {r.verdict for r in ur.judge_urls(df, [("org", "/", "allow"), ("ORG", "/", "block")]).filter("page_id = 1").collect()} == {"block"}


def test_bad_rules(spark):
    for bad in (("", "/", "allow"), ("a/b", "/", "allow"), ("a", "/", "maybe")):
        with pytest.raises(ValueError):
            ur.rule_table(spark, [bad])


def test_no_python_in_the_plan_and_query(spark, sf):
    from brindle.llm.queries import ORACLE, QUERIES

    df = QUERIES["op8_url_rules"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert spark_rows(df) == duck(ORACLE["op8_url_rules"], sf)
