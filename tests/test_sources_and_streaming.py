from __future__ import annotations

import json

import pytest

from brindle.operators.text import TextIndex
from brindle.sources import corpus
from brindle.streaming.index_maintenance import maintain_postings, open_postings, windowed_events


def test_corpus_lines(spark, tmp_path):
    lines = [{"_id": "a", "text": "one", "title": "T"}, {"id": 2, "contenido": "two"}, {"doc_id": "c", "body": ""}, {"text": "no id"}]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert {(r.source_id, r.text) for r in corpus.read_corpus(spark, str(path)).collect()} == {("a", "T one"), ("2", "two"), ("c", "")}
    path.write_text('{"id": 1, "text": "x"}\n{"id": 1, "text": "y"}\n')
    with pytest.raises(Exception, match="occurs twice"):
        corpus.read_corpus(spark, str(path)).collect()


def test_qrels_and_manifests(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query-id": "1", "corpus-id": "a", "score": 2}\n{"query-id": "1", "corpus-id": "b", "score": 0}\n')
    assert [tuple(r) for r in corpus.read_qrels(spark, str(tmp_path / "q.jsonl")).collect()] == [("1", "a")]
    media = tmp_path / "media"
    for name in ("a/10.jpg", "a/9.jpg", "b/2.png", "c.PNG", "x.txt"):
        (media / name).parent.mkdir(parents=True, exist_ok=True)
        (media / name).write_bytes(b"x")
    rows = corpus.image_manifest(spark, str(media)).orderBy("id").collect()
    assert [r.path.split("/media/")[1] for r in rows] == ["a/10.jpg", "a/9.jpg", "b/2.png", "c.PNG"]
    audio = corpus.audio_manifest(spark.createDataFrame([("s.wav", 12.6), ("t.wav", 2.0)], "path string, duration double"))
    corpus.write_manifest(audio, str(tmp_path / "m"))
    assert [(r.segment, r.start, r.end) for r in corpus.read_manifest(spark, str(tmp_path / "m")).orderBy("id").collect()] == [(0, 0.0, 5.0), (1, 5.0, 10.0), (2, 10.0, 12.6)]


def test_vector_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(corpus.vector_file([(1, "a/ñ.jpg", [1.0, 2.0]), (2, "b", [0.5, -1.0])]))
    assert sorted(tuple(r) for r in corpus.read_vector_files(spark, str(tmp_path / "v.bin")).collect()) == [(1, "a/ñ.jpg", [1.0, 2.0]), (2, "b", [0.5, -1.0])]
    with pytest.raises(ValueError):
        corpus.vector_file([(1, "a", [1.0]), (2, "b", [1.0, 2.0])])


def test_fetch_stays_below_root(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "d.txt").write_bytes(b"hello")
    row = corpus.fetch(spark, str(tmp_path / "root"), "d.txt").first()
    assert bytes(row.content) == b"hello" and row.media_type == "text/plain"
    for bad in ("../x", "/etc/passwd", "", "a/../../x"):
        with pytest.raises(ValueError):
            corpus.resolve(str(tmp_path / "root"), bad)


def test_streamed_postings(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string").write.parquet(str(source))
    stream = spark.readStream.schema("id long, text string").parquet(str(source))
    run = maintain_postings(stream, "id", "text", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    run.start().awaitTermination(120)
    spark.createDataFrame([(3, "alpha alpha")], "id long, text string").write.mode("append").parquet(str(source))
    run.start().awaitTermination(120)
    got = open_postings(spark, str(tmp_path / "out"), "id").match_top_k("alpha", 5).collect()
    want = TextIndex.build(spark.read.parquet(str(source)), "id", "text").match_top_k("alpha", 5).collect()
    assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in want]


def test_windowed_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, windowed_events(events).collect()))
