from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import words as w
from tests.llm.cases import odd_rows


def test_hash_depends_on_the_word_alone():
    h = w.Hasher()
    texts = [r[1] for r in odd_rows()]
    data, offsets = w.texts(pa.array(texts))
    hashes, starts, borders = h.rows(data, offsets)
    seen: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        own = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        assert borders[i + 1] - borders[i] == len(own)
        for word, value in zip(own, hashes[borders[i] : borders[i + 1]].tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_pieces_change_nothing(monkeypatch, piece):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 90))) for _ in range(50)] + ["x" * 500, "", "y"]
    data, offsets = w.texts(pa.array(texts))
    want = w.Hasher().rows(data, offsets)
    monkeypatch.setattr(w, "PIECE", piece)
    got = w.Hasher().rows(data, offsets)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    part = w.Hasher().rows(data, offsets[5:20])
    assert (part[0] == want[0][want[2][5] : want[2][19]]).all()


def test_slices_cover_rows():
    offsets = np.array([0, 5, 5, 100, 101, 102])
    assert list(w.slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(w.slices(np.array([0]), 10)) == []


def test_windows_stay_inside_texts():
    h, _, borders = w.Hasher().rows(*w.texts(pa.array(["a b c d", "", "a", "b c d e"])))
    runs, begins = w.windows(h, borders, 3)
    assert begins.tolist() == [0, 2, 2, 2, 4] and runs[1] == runs[2] and len(set(runs.tolist())) == 3
