from __future__ import annotations

import gzip
import hashlib
import os
import random

import pytest

from brindle.llm import warc
from tests.llm.cases import clashing

PAGES = "page_id long, url string, html string"
LONG = "é" * 600


def pages():
    return [(1, "http://a.example/x", LONG), (2, "http://b.example/ y\r\nz", LONG), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "z" * 999), (8, "u", "z" * 999), (9, "u", "z" * 1000), (10, "u", "z" * 1000), (10, "u", "z" * 1000), (None, "u", LONG), (None, None, None), (11, "big", "q" * 3_000_000)]


def expected(rows):
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 1000:
            top[b] = max(top.get(b, i), i)
    out, used = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        revisit = i is not None and b in top and (top[b] != i or b in used)
        if i is not None and top.get(b) == i:
            used.add(b)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[b] if revisit else None))
    return sorted(out, key=repr)


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("split", [300, 5000, 1 << 20])
def test_round_trip_over_any_split(spark, split):
    files = warc.write_warc(clashing(spark.createDataFrame(pages(), PAGES)), file_bytes=2000)
    assert digest(warc.read_warc(files, split)) == expected(pages())
    assert files.selectExpr("sum(records)").first()[0] == len(pages())


def test_files_are_plain_gzip_and_payloads_come_back(spark):
    files = warc.write_warc(spark.createDataFrame(pages(), PAGES))
    for r in files.collect():
        assert gzip.decompress(open(r.path.removeprefix("file://"), "rb").read()).count(b"WARC/1.1\r\n") == r.records
    got = {r.page_id: r for r in warc.read_warc(files).filter("record_type = 'response' and page_id in (2, 5, 11)").collect()}
    assert bytes(got[5].payload) == b"short" and len(got[11].payload) == 3_000_000
    assert got[2].target_uri == "http://b.example/%20y%0D%0Az" and got[2].declared_digest == got[2].payload_digest


def test_empty_table(spark):
    files = warc.write_warc(spark.createDataFrame([], PAGES))
    assert files.count() == 0 and warc.read_warc(files).count() == 0


def test_damage_costs_only_what_it_hits():
    records = [warc.encode_record(i, "u", os.urandom(300), "00" * 20, None) for i in range(20)]
    data = bytearray(b"".join(records[:10]) + b"junk\x1f\x8b\x08junk" + gzip.compress(b"not a record") + b"".join(records[10:]))
    at = sum(map(len, records[:3])) + 40
    data[at : at + 5] = b"\x00" * 5
    for split in (50, 1000, 10**6):
        got = [warc.parse_record(r)["page_id"] for s in range(0, len(data), split) for _, r in warc.members(lambda a, n: bytes(data[a : a + n]), len(data), s, min(len(data), s + split), 64)]
        assert got == [i for i in range(20) if i != 3]


def test_query(spark, sf):
    from brindle.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert digest(QUERIES["op1_warc"](spark, sf)) == expected(rows)


def test_headers_longer_than_a_read_piece_are_kept():
    rng = random.Random(3)
    urls = ["http://a.org/" + "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (10, 60_000, 200_000, 1_000_000, 20)]
    data = b"".join(warc.encode_record(i, u, b"page", hashlib.sha1(b"page").hexdigest(), None) for i, u in enumerate(urls))
    for step in (1 << 10, 1 << 16):
        found = [warc.parse_record(r) for _, r in warc.members(lambda at, n: data[at : at + n], len(data), 0, len(data), step)]
        assert [r["target_uri"] for r in found] == urls
