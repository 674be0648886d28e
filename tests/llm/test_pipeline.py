from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from brindle.llm import decontam, near_dedup, token_files, toxicity
from brindle.llm.runtime import stored
from tests.llm.cases import clashing, odd_docs

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_act_on_what_came_before(spark, sf, tmp_path):
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = start.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["toxicity"]
    flagged = {r.doc_id for r in toxicity.toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids(after) == sorted(set(ids(before)) - flagged)
    before, after = seen["near_dedup"]
    assert ids(after) == sorted({r.component_id for r in near_dedup.near_duplicates(before, 5).collect()})
    before, after = seen["decontamination"]
    hit = {r.doc_id for r in decontam.overlaps(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids(after) == sorted(set(ids(before)) - hit)
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).count(i) for i in ids(after)) <= 2
    before, after = seen["token_output"]
    whole, start = Tokenizer.from_str(token_files.tokenizer_file()), 0
    want = []
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        i = [*whole.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((start, r.doc_id, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == sorted(want)


def test_run_and_odd_rows(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        out = docs
        for _, stage in pipeline.STAGES:
            out = stage(spark, out, sf)
        assert out.count() <= 2 * docs.count()


def test_clashing_columns_change_nothing(spark, sf, tmp_path):
    plain, out = odd_docs(spark), clashing(odd_docs(spark))
    for name, stage in pipeline.STAGES:
        columns, last = out.columns, name == pipeline.STAGES[-1][0]
        plain, out = stored(stage(spark, plain, sf), name), stored(stage(spark, out, sf), name)
        assert last or out.columns == columns
        rows = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
        assert rows(out) == rows(plain)
        assert last or {r.best_key for r in out.select("best_key").collect()} <= {"clash"}
