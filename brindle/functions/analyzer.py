"""Text analysis: a bilingual analyzer as an Arrow UDF, and a native one without stemming."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish and English function words, words that the stemmer leaves alone, vowels.
STOPWORDS = frozenset(
    "a an the and or but if of to in on at by for from with as is are was were "
    "be been being it its this that these those i you he she we they me my your "
    "our their de del la las el los y o en por para con un una unos unas es son "
    "ser se que como al lo le les su sus".split()
)
UNCHANGED = frozenset(["series", "species", "caries", "analysis", "news", "virus"])
VOWELS = frozenset("aeiouáéíóúü")

_RUN = re.compile(r"[^\W_]+")
# Suffixes of the two languages, with the lengths and letters that their rules ask for, in the order they are tried.
#: (suffix, least length of the word, letters cut, letters put instead, letters one of which must stand before)
_PLURALS = (
    ("iones", 7, 5, "ión", None),
    ("ces", 5, 3, "z", None),
    ("ies", 5, 3, "y", None),
    ("es", 6, 2, "", ("l", "r", "n", "d", "x", "z", "ch", "sh", "ss")),
)
#: (suffix, letters that must remain, whether a vowel must be among them)
_ENDINGS = (("mente", 4, False), ("ness", 4, False), ("ly", 4, False), ("ing", 3, True), ("ed", 3, True))


def singular(word: str) -> str:
    for suffix, least, cut, put, before in _PLURALS:
        if len(word) >= least and word.endswith(suffix) and (before is None or word[:-cut].endswith(before)):
            return word[:-cut] + put
    if len(word) >= 5 and word[-1] == "s" and not word.endswith(("us", "is", "ss")):
        return word[:-1]
    return word


def without_ending(word: str) -> str:
    for suffix, remain, vowel in _ENDINGS:
        base = word[: -len(suffix)]
        if not word.endswith(suffix) or len(base) < remain or (vowel and not VOWELS & set(base)):
            continue
        doubled = vowel and len(base) >= 4 and base[-1] == base[-2] and base[-1] not in VOWELS | set("lsz")
        return base[:-1] if doubled else base
    return word


def stem(word: str) -> str:
    """Plural first, then at most one adverb or verb ending; short, mixed and listed words stay."""
    if len(word) < 4 or not word.isalpha() or word in UNCHANGED:
        return word
    return without_ending(singular(word))


def analyze(text: str | None, stopwords: Collection[str] = STOPWORDS, stemming: bool = True) -> list[str]:
    """NFKC, case folding, runs of letters and digits, no stopwords, stems; order and repeats stay."""
    if text is None:
        return []
    runs = _RUN.findall(unicodedata.normalize("NFKC", text).casefold())
    return [stem(w) if stemming else w for w in runs if w not in stopwords]


def analyzer(stopwords: Collection[str] = STOPWORDS, stemming: bool = True) -> Callable[[Column], Column]:
    """The analyzer as a function of a text column; Spark has no NFKC or case folding of its own."""
    words = frozenset(stopwords)

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: analyze(t, words, stemming))

    return tokens


def native_analyzer(stopwords: Collection[str] = ()) -> Callable[[Column], Column]:
    """Lower case and runs of letters and numbers, all in the JVM; no stems, no compatibility forms."""

    def tokens(text: Column) -> Column:
        runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        return F.filter(runs, lambda w: ~w.isin(*sorted(stopwords))) if stopwords else runs

    return tokens
