"""Operator 1: WARC archives of gzip members, a deduplicating writer and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, filesystem, new_folder, partitions, stored

MAGIC = b"\x1f\x8b\x08"
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6f6d2c34-2f0e-4c0e-9d3f-2a5a1c7b9e11")


def _record_id(page: int | None, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest} {n}')}>"


def _clean(uri: str) -> str:
    """Header values hold no control characters or blanks: those are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def encode_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, n: int = 0) -> bytes:
    """One gzip member: a response with its payload, or a revisit of page ``refers_to`` without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page, digest, n)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _writer(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        task = TaskContext.get()
        tag = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"
        out, name, size, count, done, last, n = None, "", 0, 0, [], None, 0
        for batch in batches:
            for page, url, html, digest, top in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"part-{tag}-{len(done):04d}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                n = n + 1 if (page, digest) == last else 0
                last = (page, digest)
                refers = top if top is not None and (page != top or n) else None
                size += out.write(encode_record(page, url, html, digest, refers, n))
                count += 1
                if size >= most:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "bytes": [d[1] for d in done], "records": [d[2] for d in done]}, schema=_FILES)

    return write


_FILES = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def write_warc(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a WARC record per row; returns the files written (path, bytes, records).

    Of the rows with equal payloads of at least ``revisit_from`` bytes the one with the
    largest id is a response, the others revisit it; if that row is repeated, the first
    of its copies is the response. Rows with a null id, and smaller payloads, are
    responses. Null html is an empty payload, a null URL has no target header. File names
    carry the task attempt, and only files of attempts that ended are listed, so a lost
    executor leaves no half-written archive behind. An empty table lists no files.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = stored(pages.filter((F.octet_length("payload") >= revisit_from) & F.col("page").isNotNull()).select("page", "digest"), "digests")
    tops = cut(long.groupBy("digest").agg(F.max("page").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    refers = long.join(tops, "digest").distinct()
    joined = pages.join(refers.hint("merge"), ["page", "digest"], "left")
    return stored(joined.select("page", "url", "payload", "digest", "top").mapInArrow(_writer(folder, file_bytes), "path string, bytes long, records long"), "warc-files")


def members(read: Callable[[int, int], bytes], size: int, start: int, end: int, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every gzip member that begins in [start, end) and holds a WARC record.

    The range is scanned for the gzip magic; a place counts as a member if what it
    decodes to begins with a WARC version and a header that ends. After a member the
    scan goes on behind it, after anything else one byte on, so damage costs only the
    records that it hits. The last member is read beyond ``end``.
    """
    at, base, held = start, start, b""

    def upto(stop: int) -> None:
        nonlocal held, base
        have = base + len(held)
        if stop > have and have < size:
            held = held[at - base :] + read(have, min(size, max(stop, have + step)) - have)
            base = at

    while at < min(end, size):
        upto(at + 3)
        found = held.find(MAGIC, at - base)
        if found < 0:
            if base + len(held) >= size:
                return
            at = max(at, base + len(held) - 2)
            continue
        at = base + found
        if at >= end:
            return
        unpack, fed, out, good = zlib.decompressobj(31), at, [], False
        head = bytearray()
        try:
            while not unpack.eof and fed < size:
                upto(fed + 1)
                piece = held[fed - base : fed - base + step]
                out.append(unpack.decompress(piece))
                fed += len(piece)
                if not good:
                    seen = len(head)
                    head += out[-1]
                    if not head.startswith(b"WARC/"[: len(head)]):
                        break
                    good = head.find(b"\r\n\r\n", max(0, seen - 3)) >= 0
        except zlib.error:
            good = False
        if good and unpack.eof:
            yield at, b"".join(out)
            at = fed - len(unpack.unused_data)
        else:
            at += 1


def parse_record(record: bytes) -> dict:
    """Headers and payload of a WARC record; the payload of a revisit is None."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    body = body[: int(fields.get("content-length", len(body)))]
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"),
        "record_type": kind,
        "refers_to": number("x-refers-to-page-id"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": declared if kind == "revisit" else len(payload),
        "payload_digest": base64.b32decode(digest[5:]).hex() if kind == "revisit" else hashlib.sha1(payload).hexdigest(),
        "declared_digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None,
        "payload": None if kind == "revisit" else payload,
    }


_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary())])
_RECORD_DDL = "path string, offset long, page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, declared_digest string, payload binary"


def _reader(with_payload: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs, local = filesystem(path)
                with fs.open_input_file(local) as f:
                    for offset, record in members(lambda at, n, f=f: (f.seek(at), f.read(n))[1], size, start, end):
                        row = {"path": path, "offset": offset} | parse_record(record)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 300
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return scan


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Read the records of archives (path, bytes): a task's unit is a byte range, not a file.

    A range owns the records whose first byte lies in it, so every record is read once
    however the files are split.
    """
    spark = files.sparkSession
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    return ranges.repartition(partitions(spark), "path", "start").mapInArrow(_reader(with_payload), _RECORD_DDL)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    records = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
