"""Small tables of odd cases, shared by the tests of the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (60, 80, 120, 300)]
    near = base[1].split()
    near[40] = "changed"
    texts = [None, "", "   \t\n", "one", "one two three", "ONE two THREE", base[0], base[0], base[0].upper(), base[1], " ".join(near), base[2], "x " + base[2] + " y", base[3], sentence(rng, 40) + " " + base[0] + " " + sentence(rng, 30), "é" * 400 + " ß Ω 漢字 " + base[2], "a\x1cb\x85c\xa0d", "w " * 3000, sentence(rng, 60_000)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, base[3], None, None, None), (None, None, None, "s1", None), (-7, "neg " + base[0], "en", "s0", 1)]


def odd_docs(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), DOCS)


def clashing(df):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    for c in ("row_id", "text_key", "size", "shard", "host", "path", "cls", "n", "key", "keys", "root", "digest", "before_size", "kept", "score", "position", "taken", "copies", "words", "page", "payload", "range", "at", "best_key", "Position", "label", "turn", "list", "node", "bucket", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(text) -> list[bytes]:
    """Words of the contracts, A-Z lower-cased."""
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
