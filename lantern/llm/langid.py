"""Language identification by inferring each document's mixture of languages.

Training counts hashed letter trigrams (words lower-cased, with a space at either end) of
labelled rows, giving P[gram, language]. A document is taken as draws from a mixture of
these: expectation-maximisation estimates the proportions from its gram likelihoods. Which
languages are in the mixture is decided by penalised likelihood: from the best single
language on, the language that raises the likelihood most is added as long as the gain
exceeds PENALTY * ln(number of grams).

The likelihood is concave in the proportions, so with D[l] = sum of P[g, l] / P[g, best]
over a document's grams no mixture gains more than max(D) - N over the best single
language. Where that is within the penalty, the single language is the answer and no
iteration runs.

A mixture explains a text if the text is at least as likely under it as under grams drawn
evenly; reject() drops texts of EVIDENCE distinct grams or more that no learned mixture explains.

The sample: every language is learned, from about DOCS_PER_LANGUAGE rows or, with many
languages, an equal share of SAMPLE_MAX but LEAST_PER_LANGUAGE rows at least, chosen by a hash
of the id. This bounds the rows of the fit alone: their whole texts are counted, in the
executors, and only the counts reach the driver (BUCKETS of each language at most). The
prediction reads every whole text.

Cases: `und` with score 0 for a text that is null or has no letter (a character of Unicode
category L), and for every text if nothing could be learned; reject() then drops the former
alone. Ties go to the language that sorts first. A very long text is counted a slab at a time.
Repeated rows give repeated results. An empty table gives an empty result. Extra columns are
ignored, or kept by reject().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import own_names, released, sealed, unsealed

BUCKETS = 1 << 16
DOCS_PER_LANGUAGE = 800
LEAST_PER_LANGUAGE = 20
SAMPLE_MAX = 8000
#: Distinct grams from which a text can count as unexplained.
EVIDENCE = 100
PENALTY = 2.0
ROUNDS = 30
TOLERANCE = 1e-4
SMOOTHING = 0.05
UNKNOWN = "und"
#: Characters looked at in one numpy pass; longer texts go in several, none is cut short.
SLAB = 1 << 20

_MAYBE_LETTER = re.compile(r"[^\W\d_]").finditer
_NOT_WORD = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is of category L; the pattern lets some numbers through."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER(text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigram buckets of a text and how often each occurs."""
    words = " " + _NOT_WORD.sub(" ", text.lower()) + " "
    counts = None
    for lo in range(0, max(1, len(words) - 2), SLAB):
        c = np.frombuffer(words[lo : lo + SLAB + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA6B) + c[2:]
        h *= np.uint64(0x9E3779B97F4A7C15)
        here = (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        if counts is None and len(words) - 2 <= SLAB:
            return np.unique(here, return_counts=True)
        counts = np.bincount(here, minlength=BUCKETS) + (0 if counts is None else counts)
    found = np.nonzero(counts)[0]
    return found, counts[found]


class Model:
    """P: probability of each bucket (rows) in each language (columns), languages sorted."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: the buckets of each language and how often each occurs."""
        self.languages = sorted(counts)
        p = np.full((BUCKETS, len(self.languages)), SMOOTHING)
        for k, lang in enumerate(self.languages):
            found, n = counts[lang]
            p[found, k] += n
        self.p = (p / p.sum(axis=0)).astype(np.float32) if self.languages else p
        self.log_p = np.log(self.p)

    def predict(self, text: str | None) -> tuple[str, float, int, bool]:
        """(language, its proportion, number of languages in the mixture, whether it explains the text)."""
        if not text or not has_letter(text):
            return UNKNOWN, 0.0, 0, False
        if not self.languages:
            return UNKNOWN, 0.0, 0, True
        found, n = grams(text)
        n = n.astype(np.float32)
        total = float(n.sum())
        single = n @ self.log_p[found]
        best = int(np.argmax(single))
        penalty = PENALTY * np.log(total + 1)
        p = self.p[found]
        chosen, weights, likelihood = [best], np.ones(1, np.float32), float(single[best])
        gains = (n / p[:, best]) @ p
        while len(chosen) < len(self.languages):
            gains[chosen] = -np.inf
            new = int(np.argmax(gains))
            if float(gains[new]) - total <= penalty:
                break
            trial = [*chosen, new]
            w, got = self._fit(p[:, trial], n, total)
            if got - likelihood <= penalty:
                break
            chosen, weights, likelihood = trial, w, got
            gains = (n / (p[:, chosen] @ weights)) @ p
        top = max(range(len(chosen)), key=lambda k: (weights[k], -chosen[k]))
        explained = len(found) < EVIDENCE or likelihood >= -total * float(np.log(BUCKETS))
        return self.languages[chosen[top]], min(1.0, float(weights[top])), len(chosen), explained

    def _fit(self, p: np.ndarray, n: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        w = np.full(p.shape[1], 1 / p.shape[1], np.float32)
        for _ in range(ROUNDS):
            new = w * ((n / (p @ w)) @ p) / np.float32(total)
            moved = float(np.abs(new - w).max())
            w = new
            if moved < TOLERANCE:
                break
        w /= w.sum()
        return w, float(n @ np.log(p @ w))


@released
def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) -> (lang, bucket, n), combined within a batch."""
    for b in batches:
        for lang, texts in b.groupby("lang")["text"]:
            counts = np.zeros(BUCKETS, np.int64)
            for text in texts:
                found, n = grams(text)
                counts[found] += n
            found = np.nonzero(counts)[0]
            yield pd.DataFrame({"lang": lang, "bucket": found.astype(np.int32), "n": counts[found]})


def train(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, lang. Only the sample's counts reach the driver."""
    rows = labelled.where("text is not null and lang is not null").select(
        F.xxhash64("doc_id", F.length("text")).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sizes = rows.groupBy("lang").count().collect()  # as many rows as there are languages
    if not sizes:
        return Model({})
    each = max(LEAST_PER_LANGUAGE, min(DOCS_PER_LANGUAGE, SAMPLE_MAX // len(sizes)))
    share = labelled.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sizes], "lang string, share double")
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")
    counts = picked.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).collect()
    return Model({r["lang"]: (np.array(r["bucket"], np.int64), np.array(r["n"], np.float64)) for r in found})


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, model: Model) -> DataFrame:
    """df with lang_pred, score, n_languages and explained after its own columns (suffixed if taken)."""
    pred, score, count, explained, text = own_names(df, "lang_pred", "score", "n_languages", "explained", "_text")
    told = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS of each language

    @released
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([told.value.predict(x) for x in texts], columns=["lang", "score", "n", "explained"])

    guess = F.pandas_udf(predict, "lang string, score double, n int, explained boolean")
    kept = df.withColumn(text, guess(F.col("text").cast("string")))
    return kept.select(
        *(F.col(f"`{c}`") for c in df.columns), F.col(text)["lang"].alias(pred), F.col(text)["score"].alias(score), F.col(text)["n"].alias(count),
        F.col(text)["explained"].alias(explained),
    )


def identify_documents(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages, explained; learned from the rows not held out."""
    model = train(df.where(~held_out()).select("doc_id", "text", "lang"))
    rows = df.select(sealed("doc_id").alias("doc_id"), "text")
    told = df.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([told.value.predict(x) for x in b["text"]], columns=["lang_pred", "score", "n_languages", "explained"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    found = rows.mapInPandas(run, "doc_id long, lang_pred string, score double, n_languages int, explained boolean")
    return found.withColumn("doc_id", unsealed("doc_id")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_languages", "explained")


def reject(df: DataFrame) -> DataFrame:
    """The rows of df whose text a mixture of the learned languages explains, with df's own columns."""
    model = train(df.where(~held_out()).select("doc_id", "text", "lang"))
    marked = identify(df, model)
    return marked.where(marked.columns[-1]).select(*(F.col(f"`{c}`") for c in df.columns))
