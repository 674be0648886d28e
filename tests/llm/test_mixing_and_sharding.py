from __future__ import annotations

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest

from brindle.llm import mixing, sharding
from brindle.llm.runtime import global_prefix
from tests.llm.cases import clashing, odd_docs, odd_rows, words


def water_fill(sizes: dict, weights: dict, share=Fraction(3, 2), cap=2):
    """Targets by literal resharing: what is above its cap stops there, the rest is dealt anew."""
    budget, done = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in done]
        left = budget - sum(done.values())
        total = sum(weights[s] for s in rest)
        target = {s: Fraction(left) * weights[s] / total for s in rest}
        over = [s for s in rest if target[s] >= cap * sizes[s]]
        if not over:
            return {**done, **target}
        done |= {s: Fraction(cap * sizes[s]) for s in over}
        if len(done) == len(sizes):
            return done


def check_mix(rows, got):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    want = water_fill(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert len(got) == len(rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        s = r.kept_source
        assert r.source_size == size[s] and r.target == pytest.approx(float(want[s])) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1


def test_mix_odd_cases(spark):
    check_mix(odd_rows(), mixing.plan_mix(clashing(odd_docs(spark)), keep=["source"]).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_targets_and_reruns(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice([None, "a", "b", "ä", "Z", "z"] if i % 3 else ["a"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, odd_docs(spark).schema)
    plan = mixing.plan_mix(df, keep=["source"])
    check_mix(rows, plan.collect())
    again = mixing.plan_mix(df.repartition(7), keep=["source"])
    assert sorted(map(tuple, plan.drop("positions").collect()), key=repr) == sorted(map(tuple, again.drop("positions").collect()), key=repr)
    ordered = [r.position for r in mixing.order_mix(plan).collect()]
    some = [p for p in ordered if p is not None]
    assert some == sorted(some) and ordered[: len(some)] == some and all(0 <= p <= 1 for p in some)


def test_positions_invert_the_schedule(spark):
    rows = [(i, "w " * 10, "en", s, 0) for i, s in enumerate(["a", "b", "c"] * 300)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, odd_docs(spark).schema)).collect()
    for k, target in enumerate(sorted({(r.target) for r in plan}, reverse=True)):
        knots = mixing.SCHEDULES[k]
        (_, w0), (_, w1) = knots
        for t in (0.25, 0.5, 0.75):
            demand = target * (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            have = sum(r.size for r in plan if r.target == target for p in r.positions if p < t)
            assert abs(have - demand) <= 10


def test_mix_empty(spark):
    assert mixing.plan_mix(odd_docs(spark).limit(0)).count() == 0
    assert {r.taken for r in mixing.plan_mix(odd_docs(spark).filter("doc_id between 0 and 2")).collect()} == {0}


def test_global_prefix(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id", "id % 7 as size")
    got = sorted(global_prefix(df, ["k", "id"], ["size"]).collect(), key=lambda r: (r.k, r.id))
    total = 0
    for n, r in enumerate(got):
        assert (r.before_size, r.before_rows) == (total, n)
        total += r.size


def check_shards(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, sums = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    even, most = sum(sums.values()) / shards, max(r.size for r in got)
    assert all(abs(sums[s] - even) <= most + 1 for s in range(shards))


def test_shards_odd_cases(spark):
    rows = odd_rows()
    for shards in (1, 3, 40):
        check_shards(rows, sharding.shard_by_bytes(clashing(odd_docs(spark)), shards).collect(), shards)
    assert sharding.shard_by_bytes(odd_docs(spark).limit(0)).count() == 0


def test_shards_keep_small_groups_whole_and_part_large_ones(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(10, 400), None, None, None) for i in range(400)] + [(1000 + i, "many " * 20, None, None, None) for i in range(900)]
    rows += [(5000 + i, "big " * 300, None, None, None) for i in range(2)] + [(6000 + i, f"pair {i // 3}", None, None, None) for i in range(60)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, odd_docs(spark).schema), 10).collect()
    check_shards(rows, got, 10)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    text = {d: t for d, t, *_ in rows}
    assert all(len(where[zlib.crc32(text[6000 + i].encode())]) == 1 for i in range(60))
    assert len(where[zlib.crc32(("many " * 20).encode())]) > 2
    again = sharding.shard_by_bytes(spark.createDataFrame(rows[::-1], odd_docs(spark).schema).repartition(9), 10).collect()
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((r.doc_id, r.shard) for r in again)


def test_queries(spark, sf):
    from brindle.llm.queries import ORACLE, QUERIES
    from tests.compare import duck, spark_rows

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(rows, QUERIES["op7_shards"](spark, sf).collect(), 40)
    assert spark_rows(QUERIES["op3_mix"](spark, sf)) == duck(ORACLE["op3_mix"], sf)
