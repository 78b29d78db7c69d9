from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lantern.functions import decode, fixed, terms

GOLDEN = {
    "running": "runn", "relational": "rel", "nationalization": "national", "happiness": "happi", "studies": "stud", "tables": "tabl",
    "this": "thi", "cafés": "café", "ÉCOLE": "École", "Оплата": "оплат", "ответственность": "ответственнос", "документов": "документ",
    "ёлка": "елк", "Ещё": None, "a": None, "5": None, "42": "42", "ы": "ы",
}


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_fixed_lists_have_their_checksums():
    digest = lambda words: hashlib.sha256("\n".join(words).encode()).hexdigest()[:12]
    assert (len(fixed.STOP_WORDS), digest(fixed.STOP_WORDS)) == (112, "218e194a8466")
    assert (len(fixed.RUSSIAN_SUFFIXES), digest(fixed.RUSSIAN_SUFFIXES)) == (64, "dd6a308562a7")
    assert (len(fixed.ENGLISH_SUFFIXES), digest(fixed.ENGLISH_SUFFIXES)) == (22, "31af32f93725")


def test_terms(spark):
    rows = spark.createDataFrame(list(GOLDEN.items()), "word string, term string")
    for r in rows.select("word", "term", terms.normalise(terms.fold("word")).alias("got"), terms.terms("word").alias("all")).collect():
        assert r["got"] == r["term"] and r["all"] == ([r["term"]] if r["term"] else [])
        assert terms.py_normalise(r["word"]) == (r["term"] or "")


def test_tokens_grams_and_queries(spark):
    assert col(spark, "Foo_bar, x-RAY's é1", terms.raw_tokens) == ["foo", "bar", "x", "ray", "s", "é1"]
    assert col(spark, "tables Table TABLES paper", terms.query_terms) == ["tabl", "table", "paper"]
    assert col(spark, "abab", terms.grams) == ["aba", "bab"] and col(spark, "ab", terms.grams) == ["ab"]
    pairs = terms.alias_pairs()
    assert ("search", "поиск") in pairs and ("ml", "ai") in pairs and len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert terms.aliases(spark).count() == len(pairs)


@pytest.mark.parametrize(
    ("data", "text"),
    [
        (b"\xef\xbb\xbfabc", "abc"), ("яб".encode("utf-16-le").join([b"\xff\xfe", b""]), "яб"), ("яб".encode("utf-16-be").join([b"\xfe\xff", b"\x00"]), "яб"),
        ("дом".encode(), "дом"), ("дом Ё".encode("cp1251"), "дом Ё"), (b"\x81\xe4", "?д"), (b"", ""),
    ],
)
def test_charsets(spark, data, text):
    assert col(spark, bytearray(data), decode.text_of_bytes, "binary") == text


def test_markdown(spark):
    md = "# Head\n![i](u) [label](u)\n- one\n* two\n1. three\n10. ten\n~~~\nhidden\n~~~\n```\nshown\nsnake_case\n"
    assert col(spark, md, decode.strip_markdown) == "Head\n  label\none\n two\nthree\n10. ten\n\nshown\nsnakecase\n".replace("\n\nshown", "\n\nshown")


def test_docx_xml_and_entities(spark):
    xml = "<w:p>a<w:tab/>b<w:br/>c</w:p><w:tc>d</w:tc>&amp;lt;&lt;"
    assert col(spark, xml, decode.docx_xml_text) == "a\tb\nc\n\nd\t&lt;<"


def test_mojibake_and_controls(spark):
    broken = "Договор поставки".encode("cp1251").decode("latin-1")
    assert col(spark, broken, decode.repair_mojibake) == "Договор поставки"
    assert col(spark, "caféé", decode.repair_mojibake) == "caféé"
    assert col(spark, "a\fb\x01c\x85d", decode.strip_controls) == "a\nb c d"
    q = col(spark, "Дa\x01é", decode.quality)
    assert (q["cyrillic"], q["latin1_suspect"], q["word_chars"], q["controls"]) == (1, 1, 3, 1)


def test_pdf_cleanup_and_probe(spark):
    assert col(spark, "one two", decode.clean_pdf_text) == ""
    assert col(spark, "alpha bravo charlie delta\r\n", decode.clean_pdf_text) == "alpha bravo charlie delta\n"
    p = col(spark, bytearray(b"%PDF /Font \nBT (x) Tj /Subtype /Image ''''' /Type /Page"), decode.pdf_probe, "binary")
    assert (p["font_markers"], p["image_markers"], p["text_markers"], p["page_markers"]) == (1, 2, 3, 1)
    assert p["likely_textual"] and p["try_fallback"] and not p["likely_scanned"] and p["max_output_bytes"] == 16 << 20
