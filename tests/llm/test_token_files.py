from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import token_files as tf
from tests.llm.cases import clashing, odd_docs, odd_rows


@pytest.fixture(scope="module")
def definition():
    return tf.tokenizer_file()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abzAZ'sTLlr09 \t\n.,!|<>-_éÉßİñΣςªº½²́한글日\u00a0\u0085\u001c\u2028😀")), max_size=40), max_size=6))
def test_encoder_equals_the_library(texts):
    definition = tf.tokenizer_file()
    whole = Tokenizer.from_str(definition)
    got = tf.encoder(definition).encode([t.encode() for t in texts])
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_with_special_strings_and_forgetting(definition, monkeypatch):
    monkeypatch.setattr(tf, "WORDS_KEPT", 8)
    whole, code = Tokenizer.from_str(definition), tf.Encoder(definition)
    for t in ("<|endoftext|>a b<|startoftext|>. it's DON'T rock'n'roll dogs' ''", " ".join(f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(200)), "a b a b"):
        (raw,) = code.encode([t.encode()])
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [
    lambda d: d["normalizer"]["normalizers"][0].update(type="NFKC"),
    lambda d: d["added_tokens"].append(d["added_tokens"][0] | {"id": 49408, "content": "dog"}),
    lambda d: d["added_tokens"].append(d["added_tokens"][0] | {"id": 49408, "content": "<a b>"}),
    lambda d: d["added_tokens"][1].update(lstrip=True),
    lambda d: d["model"].update(end_of_word_suffix=None),
    lambda d: d.update(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    lambda d: d.update(truncation={"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}),
])
def test_other_definitions_encode_whole_texts(definition, change):
    """Definitions that differ in any part are given to the library text by text, uncut."""
    parts = json.loads(definition)
    change(parts)
    other, whole = json.dumps(parts), Tokenizer.from_str(json.dumps(parts))
    whole.no_truncation()
    code = tf.Encoder(other)
    assert not code.plain and tf.Encoder(definition).plain
    for t in ("the  dog\tdogs <a b> hot<|endoftext|> x", "", "ﬁn Éa \n\n it's"):
        assert np.frombuffer(code.encode([t.encode()])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(0, 1 << rng.integers(1, 32), rng.integers(0, 400)).astype("<u4")) for i in range(60)] + [(99, np.zeros(0, "<u4")), (100, np.arange(5000, dtype="<u4"))]
    out = io.BytesIO()
    w = tf.TokenWriter(out, kind, block=256)
    for d, ids in docs:
        w.add(d, ids.tobytes())
    size = w.close()
    assert size == len(out.getvalue())
    got = list(tf.TokenReader(out, size).documents())
    assert [d for d, _ in got] == [d for d, _ in docs] and all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(got, docs, strict=True))
    reader = tf.TokenReader(out, size)
    every = np.concatenate([ids for _, ids in docs])
    assert (reader.block(3) == every[3 * 256 : 4 * 256]).all()
    broken = bytearray(out.getvalue())
    broken[-tf.TAIL.size - 3] ^= 1
    with pytest.raises(ValueError):
        tf.TokenReader(io.BytesIO(bytes(broken)), size)
    with pytest.raises(ValueError):
        tf.TokenWriter(io.BytesIO(), "nibble")


def check(rows, got, definition):
    whole = Tokenizer.from_str(definition)
    import hashlib

    start, want = 0, []
    for d, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((s, d, n, c) for d, s, n, c in want)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_odd_cases(spark, definition, kind):
    files = tf.write_tokens(clashing(odd_docs(spark)), definition, kind=kind)
    check(odd_rows(), tf.read_tokens(files).collect(), definition)


def test_empty_and_query(spark, sf, definition):
    from brindle.llm.queries import QUERIES

    assert tf.read_tokens(tf.write_tokens(odd_docs(spark).limit(0), definition)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op6_token_files"](spark, sf).collect(), definition)
