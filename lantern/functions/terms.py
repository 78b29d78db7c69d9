"""Tokens and terms as column expressions: folding, word runs, suffix removal, stop words, 3-grams, aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import fixed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0x410, 0x430))) + "Ёё"
LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x430, 0x450))) + "ее"
#: Runs of word characters of a folded text.
WORD = "[a-z0-9Ѐ-ӿÀ-ɏ]+"
#: A trim set that the JVM's own trim does not have.
BLANKS = " \t\r\n\f\x0b"


def suffix_pattern(suffixes: list[str]) -> str:
    """Three characters at least, then a suffix. No suffix of the lists comes before a longer
    one that ends in it, so the longest match is the first of the list."""
    return f"^(.{{3,}}?)(?:{'|'.join(dict.fromkeys(suffixes))})$"


RUSSIAN, ENGLISH = suffix_pattern(fixed.RUSSIAN_SUFFIXES), suffix_pattern(fixed.ENGLISH_SUFFIXES)


def fold(text: Column | str) -> Column:
    """A-Z, А-Я lower-cased, Ё and ё as е; nothing else changes."""
    return F.translate(text, UPPER, LOWER)


def trim(text: Column | str) -> Column:
    return F.trim(text if isinstance(text, Column) else F.col(text), F.lit(BLANKS))


def raw_tokens(text: Column | str) -> Column:
    """The word runs of a text, folded, in order."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(0))


def _without(folded: Column, suffixes: list[str]) -> Column:
    """Without the longest of the suffixes that leaves three characters; one look-up for each length."""
    size = F.length(folded)
    cut = None
    for n in sorted({len(x) for x in suffixes}, reverse=True):
        found = (size >= n + 3) & F.right(folded, F.lit(n)).isin([x for x in dict.fromkeys(suffixes) if len(x) == n])
        short = F.substring(folded, F.lit(1), size - n)
        cut = F.when(found, short) if cut is None else cut.when(found, short)
    return cut.otherwise(folded)


def _counts(stem: Column) -> Column:
    return (F.octet_length(stem) > 1) & ~stem.isin(fixed.STOP_WORDS)


def normalise(folded: Column) -> Column:
    """The term of a folded word, null if it is a stop word or under two bytes long."""
    return F.get(F.filter(_stems(F.filter(F.array(folded), lambda w: ~w.isin(fixed.STOP_WORDS))), _counts), F.lit(0))


def _stems(words: Column) -> Column:
    russian = F.transform(words, lambda w: _without(w, fixed.RUSSIAN_SUFFIXES))
    return F.transform(russian, lambda w: _without(w, fixed.ENGLISH_SUFFIXES))


def stemmed(words: DataFrame, raw: str = "raw") -> DataFrame:
    """words and stem, that of the folded word in raw.

    In rows, not in arrays, so that all of it is compiled. Each step is made by a generator, which
    neither a projection nor a filter is merged with: what refers to a step does not repeat it."""
    d = words.select("*", F.explode(F.array(_without(F.col(raw), fixed.RUSSIAN_SUFFIXES))).alias("_russian"))
    return d.select(*words.columns, F.explode(F.array(_without(F.col("_russian"), fixed.ENGLISH_SUFFIXES))).alias("stem"))


def with_terms(words: DataFrame, raw: str = "raw") -> DataFrame:
    """words and term, null where the word has none."""
    some = ~F.col(raw).isin(fixed.STOP_WORDS) & _counts(F.col("stem"))
    return stemmed(words, raw).select(*words.columns, F.when(some, F.col("stem")).alias("term"))


def term_rows(words: DataFrame, raw: str = "raw") -> DataFrame:
    """words with term in place of raw; words without a term are left out."""
    d = stemmed(words.where(~F.col(raw).isin(fixed.STOP_WORDS)), raw).where(_counts(F.col("stem")))
    return d.select(*(c for c in words.columns if c != raw), F.col("stem").alias("term"))


def terms(text: Column | str) -> Column:
    """The terms of a text in order, repeats included; for short texts, such as queries."""
    words = F.filter(raw_tokens(text), lambda w: ~w.isin(fixed.STOP_WORDS))
    return F.filter(_stems(words), _counts)


def query_terms(text: Column | str) -> Column:
    """The distinct terms of a query by first occurrence."""
    return F.array_distinct(terms(text))


def grams(term: Column) -> Column:
    """The distinct runs of three characters (of fewer, if the term is shorter)."""
    size = F.least(F.length(term), F.lit(3))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term) - size + 1), lambda k: F.substring(term, k, size)))


def py_fold(text: str) -> str:
    return text.translate(_FOLD)


def py_normalise(word: str) -> str:
    """normalise() for a word of the driver's; empty where that is null."""
    word = py_fold(word)
    if word in _STOPS:
        return ""
    stem = word
    for pattern, last in _ENDINGS:
        if stem[-1:] in last and (m := pattern.match(stem)):
            stem = m[1]
    return "" if len(stem.encode()) <= 1 or stem in _STOPS else stem


_FOLD = str.maketrans(UPPER, LOWER)
#: Both patterns with the letters that their suffixes end in.
_ENDINGS = tuple((re.compile(p), frozenset(x[-1] for x in s)) for p, s in ((RUSSIAN, fixed.RUSSIAN_SUFFIXES), (ENGLISH, fixed.ENGLISH_SUFFIXES)))
_STOPS = frozenset(fixed.STOP_WORDS)
PY_WORD = re.compile(f"(?:{WORD})")


def alias_pairs() -> list[tuple[str, str]]:
    """(term, alias) for every two different terms of a group."""
    out: dict[tuple[str, str], None] = {}
    for group in fixed.ALIAS_GROUPS:
        members = [t for w in group.split() if (t := py_normalise(w))]
        out |= {(a, b): None for a in members for b in members if a != b}
    return list(out)


def aliases(spark: SparkSession) -> DataFrame:
    """The fixed alias table (term, alias); its size is that of a word list."""
    rows = ", ".join(f"('{a}', '{b}')" for a, b in alias_pairs())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS aliases(term, alias)")
