"""Sources and sinks: JSONL corpora, media manifests, vector files, served documents."""

from __future__ import annotations

import mimetypes
import os
import struct
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted field names of corpus lines, in order of preference.
ID_FIELDS = ("_id", "id", "doc_id")
TEXT_FIELDS = ("text", "contenido", "body", "content")
VECTOR_MAGIC = b"VEC1"


def _first(fields: Sequence[str]) -> Column:
    return F.coalesce(*(F.col(f) for f in fields))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, text) of a JSONL corpus; a title goes before the text, malformed lines are passed over.

    An id that occurs twice is an error, raised by the job that reads the rows.
    """
    names = [*ID_FIELDS, *TEXT_FIELDS, "title"]
    lines = spark.read.text(path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    row = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    body = _first(TEXT_FIELDS)
    good = row.select(_first(ID_FIELDS).alias("source_id"), F.when(F.length(F.trim(F.coalesce("title", F.lit("")))) > 0, F.concat_ws(" ", "title", body)).otherwise(body).alias("text"))
    good = good.filter("source_id is not null and text is not null")
    counted = good.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("document id occurs twice: "), "source_id"))).otherwise(F.col("text"))
    return counted.select("source_id", once.alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of relevant judgements: grade above 0."""
    schema = "`query-id` string, `corpus-id` string, score int"
    return spark.read.schema(schema).json(path).filter("score > 0").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"))


def image_manifest(spark: SparkSession, folder: str, suffixes: Sequence[str] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """(id, type, path) of the image files below a folder, numbered in order of their path."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    files = files.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    number = (F.row_number().over(Window.orderBy("path")) - 1).cast("int")  # file names only
    return files.select(number.alias("id"), F.lit("image").alias("type"), "path")


def audio_manifest(files: DataFrame, seconds: float = 5.0, tail: float = 0.5) -> DataFrame:
    """(id, type, path, segment, start, end) from (path, duration): whole segments, and a tail of at least half of one."""
    from pyspark.sql import Window

    whole = F.floor(F.col("duration") / seconds)
    n = (whole + F.when(F.col("duration") - whole * seconds >= tail * seconds, 1).otherwise(0)).cast("int")
    rows = files.filter(n > 0).select("path", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("segment"))
    number = (F.row_number().over(Window.orderBy("path", "segment")) - 1).cast("int")
    return rows.select(number.alias("id"), F.lit("audio_segment").alias("type"), "path", "segment", (F.col("segment") * seconds).alias("start"), F.least((F.col("segment") + 1) * seconds, F.col("duration")).alias("end"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, type string, path string, segment int, start double, end double").json(path)


def vector_file(rows: Sequence[tuple[int, str, Sequence[float]]]) -> bytes:
    """The bytes of a vector file: header (magic, version, count, dimension), then id, path and floats of each record."""
    dimension = len(rows[0][2]) if rows else 0
    out = [struct.pack("<4sIII", VECTOR_MAGIC, 1, len(rows), dimension)]
    for key, path, vector in rows:
        if len(vector) != dimension:
            raise ValueError("all vectors have one dimension")
        name = path.encode()
        out.append(struct.pack("<qI", key, len(name)) + name + struct.pack(f"<{dimension}f", *vector))
    return b"".join(out)


def _records(data: bytes) -> Iterator[tuple[int, str, list[float]]]:
    magic, _, count, dimension = struct.unpack_from("<4sIII", data)
    if magic != VECTOR_MAGIC:
        raise ValueError("not a vector file")
    at = 16
    for _ in range(count):
        key, n = struct.unpack_from("<qI", data, at)
        at += 12
        yield key, data[at : at + n].decode(), list(struct.unpack_from(f"<{dimension}f", data, at + n))
        at += n + 4 * dimension


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, vector) of vector files; a file is a task's unit. Parquet is the format to keep vectors in."""

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(list(_records(bytes(content))), columns=["id", "path", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(explode, "id long, path string, vector array<float>")


def media_type(reference: str) -> str:
    return mimetypes.guess_type(reference)[0] or "application/octet-stream"


def resolve(root: str, reference: str) -> str:
    """A path below root for a relative reference; anything that would leave root is an error."""
    parts = PurePosixPath(reference)
    if parts.is_absolute() or ".." in parts.parts or not parts.parts or "\x00" in reference:
        raise ValueError(f"reference {reference!r} leaves the root")
    full, base = os.path.realpath(os.path.join(root, *parts.parts)), os.path.realpath(root)
    if os.path.commonpath([full, base]) != base:
        raise ValueError(f"reference {reference!r} leaves the root")
    return full


def fetch(spark: SparkSession, root: str, reference: str) -> DataFrame:
    """(path, media_type, length, content) of one document below root."""
    df = spark.read.format("binaryFile").load("file://" + resolve(root, reference))
    return df.select("path", F.lit(media_type(reference)).alias("media_type"), "length", "content")
