"""Snippets, highlighting and extractive answers for ranked results (a few rows per query)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.terms import BLANKS, PY_WORD, py_fold, py_normalise, terms
from lantern.operators.expand import base_terms, expand
from lantern.operators.fragments import sentences
from lantern.operators.index import Index
from lantern.operators.search import fragments_of
from lantern.plans.physical import checkpoint

MARK, PLAIN = "\x1b[1;33m", "\x1b[0m"
BEFORE, AFTER, NO_MATCH = 220, 420, 180
ANSWER_BYTES, ANSWER_TAIL_BYTES, ANSWERS = 520, 450, 5


def anchor(metadata_only: Column, ordinal: Column) -> Column:
    return F.when(metadata_only, "#filename").otherwise(F.concat(F.lit("#fragment-"), ordinal.cast("string")))


def highlight(text: str, wanted: set[str]) -> str:
    """Words whose term is wanted, in colour."""
    out, at = [], 0
    for m in PY_WORD.finditer(py_fold(text)):  # folding keeps the number of characters
        if py_normalise(m[0]) in wanted and wanted:
            out += [text[at : m.start()], MARK, text[m.start() : m.end()], PLAIN]
            at = m.end()
    return "".join([*out, text[at:]])


def snippet(text: str, wanted: set[str], colour: bool = False) -> str:
    """What stands around the first wanted word, by bytes, without splitting a character."""
    data = text.encode()
    match = next((m.start() for m in PY_WORD.finditer(py_fold(text)) if py_normalise(m[0]) in wanted), None)
    at = len(text[:match].encode()) if match is not None else min(len(data), NO_MATCH)
    start, end = max(0, at - BEFORE), min(len(data), at + AFTER)
    while start < len(data) and data[start] & 0xC0 == 0x80:
        start += 1
    while 0 < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    shown = data[start:end].decode("utf-8", "ignore").replace("\n", " ").strip(BLANKS)
    shown = f"{'...' if start else ''}{shown}{'...' if end < len(data) else ''}"
    return highlight(shown, wanted) if colour else shown


def overlap(sentence: Column, wanted: Column) -> Column:
    """The share of wanted terms that the sentence holds."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, terms(sentence))) / F.size(wanted))


def _cut_bytes(text: Column, size: int) -> Column:
    view = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.decode(F.encode(F.regexp_extract(view, f"(?s)^(.{{0,{size}}})(?![\\x80-\\xBF])", 1), "ISO-8859-1"), "UTF-8")


def best_sentences(rows: DataFrame) -> DataFrame:
    """rows (qid, fragment_id, text, base: the query's terms) -> qid, fragment_id, sentence, overlap.

    The first sentence of the greatest overlap; over 520 bytes it is cut and ends in dots."""
    cut = rows.select("qid", "fragment_id", "base", F.posexplode(sentences(F.col("text"))).alias("k", "s"))
    scored = cut.select("qid", "fragment_id", "k", "s", overlap(F.col("s"), F.col("base")).alias("o"))
    best = scored.groupBy("qid", "fragment_id").agg(F.max_by(F.struct("s", "o"), F.struct("o", -F.col("k"))).alias("b"))
    s = F.col("b.s")
    shown = F.when(F.octet_length(s) > ANSWER_BYTES, F.concat(_cut_bytes(s, ANSWER_BYTES), F.lit("..."))).otherwise(s)
    return best.select("qid", "fragment_id", shown.alias("sentence"), F.col("b.o").alias("overlap"))


def present(index: Index, queries: DataFrame, results: DataFrame, colour: bool = False, fuzzy: bool = True) -> DataFrame:
    """qid, place, score, source, snippet of ranked results, ready to print."""
    wanted = expand(base_terms(queries), index.vocab_grams if fuzzy else None).groupBy("qid").agg(F.collect_set("term").alias("wanted"))
    rows = (
        fragments_of(index, checkpoint(results), "ordinal", "text", "metadata_only")
        .join(index.documents.select("doc_id", "path"), "doc_id").join(wanted, "qid")
        .select("qid", "place", "score", F.concat("path", anchor(F.col("metadata_only"), F.col("ordinal"))).alias("source"), "text", "wanted")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shown = [snippet(t, set(w), colour) for t, w in zip(b["text"], b["wanted"], strict=True)]
            yield b[["qid", "place", "score", "source"]].assign(snippet=shown)

    return rows.mapInPandas(run, "qid long, place int, score double, source string, snippet string")


def answers(index: Index, queries: DataFrame, results: DataFrame) -> DataFrame:
    """qid, place, answer, source: the best sentence of up to five results."""
    base = base_terms(queries).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("base"))
    top = checkpoint(results.where(F.col("place") <= ANSWERS))
    rows = fragments_of(index, top, "ordinal", "text", "metadata_only").join(index.documents.select("doc_id", "path"), "doc_id")
    found = best_sentences(rows.join(base, "qid").select("qid", "fragment_id", "text", "base"))
    source = F.concat("path", anchor(F.col("metadata_only"), F.col("ordinal"))).alias("source")
    text = F.coalesce("sentence", _cut_bytes(F.col("text"), ANSWER_TAIL_BYTES)).alias("answer")
    return rows.join(found, ["qid", "fragment_id"], "left").select("qid", "place", text, source)


def printed(shown: DataFrame) -> DataFrame:
    """qid, line: results as text."""
    line = F.format_string("[%d] score=%.3f  %s\n%s", "place", "score", "source", "snippet")
    return shown.select("qid", "place", line.alias("line"))

