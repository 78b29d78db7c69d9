"""Decoding and repair of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions import fixed
from lantern.functions.terms import terms, trim

_HIGH = "".join(map(chr, range(0x80, 0x100)))
_PAGE = "".join(fixed.CODE_PAGE.get(k, "?") for k in range(0x80, 0xC0)) + "".join(map(chr, range(0x410, 0x450)))
CYRILLIC = "[Ѐ-ԯⷠ-ⷿꙀ-ꚟ]"
SUSPECT = "[À-ÿ\u0080-\u009f\u001c\u001d]"
CONTROL = "[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f&&[^\x7f]]"
ANY_WORD = "[A-Za-z0-9Ѐ-ӿÀ-ɏ]"
PREFIX_BYTES = 1 << 20
MIB = 1 << 20


def byte_view(text: Column) -> Column:
    """A text's UTF-8 bytes as characters 0 to 255, for byte-counting patterns."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_byte_view(view: Column) -> Column:
    return F.decode(F.encode(view, "ISO-8859-1"), "UTF-8")


def code_page(content: Column) -> Column:
    """Bytes in the single-byte code page as text."""
    return F.translate(F.decode(content, "ISO-8859-1"), _HIGH, _PAGE)


def text_of_bytes(content: Column) -> Column:
    """UTF-8 with a mark, UTF-16 of either order with a mark, valid UTF-8, else the code page."""
    even = (F.length(content) - 2) - F.pmod(F.length(content) - 2, F.lit(2))
    rest = F.substring(content, F.lit(3), even)
    return (
        F.when(F.startswith(content, F.lit(b"\xef\xbb\xbf")), F.make_valid_utf8(F.substring(content, F.lit(4), F.length(content)).cast("string")))
        .when(F.startswith(content, F.lit(b"\xff\xfe")), F.decode(rest, "UTF-16LE"))
        .when(F.startswith(content, F.lit(b"\xfe\xff")), F.decode(rest, "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(code_page(content))
    )


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_markdown(text: Column) -> Column:
    """Images to a space, links to their labels, emphasis and back ticks away; then line by
    line: ~~~ fences and what they hold away, heading, bullet and one-digit marks away."""
    t = newlines(text)
    for pattern, to in ((r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[([^\]]+)\]\([^\)]*\)", "$1"), (r"`+", ""), (r"\*\*|__|\*|_", "")):
        t = F.regexp_replace(t, pattern, to)
    # A final newline ends the last line and begins no other.
    lines = F.split(F.regexp_replace(t, "\n$", ""), "\n", -1)

    def shown(line: Column) -> Column:
        bare = F.regexp_replace(line, "^#+ ", "")
        cut = trim(bare)
        return (
            F.when(F.regexp_like(cut, F.lit("^[0-9]\\. ")), F.substring(cut, F.lit(4), F.length(cut)))
            .when(F.regexp_like(cut, F.lit("^[-*+] ")), F.substring(cut, F.lit(3), F.length(cut))).otherwise(bare)
        )

    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        fence = F.startswith(trim(line), F.lit("~~~"))
        keep = ~fence & ~a["code"]
        return F.struct((a["code"] != fence).alias("code"), F.when(keep, F.concat(a["out"], F.array(shown(line)))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(lines, start, step, lambda a: a["out"])
    return F.when(F.length(t) == 0, "").otherwise(F.when(F.size(done) == 0, "").otherwise(F.concat(F.array_join(done, "\n"), F.lit("\n"))))


def xml_entities(text: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def docx_xml_text(xml: Column) -> Column:
    """Tabs, breaks, cells and paragraphs as white space; other tags away; entities decoded."""
    for pattern, to in (("<w:tab[^>]*/>", "\t"), ("<w:br[^>]*/>", "\n"), ("</w:tc>", "\t"), ("</w:p>", "\n\n"), ("<[^>]+>", "")):
        xml = F.regexp_replace(xml, pattern, to)
    return newlines(xml_entities(xml))


def quality(text: Column) -> Column:
    """Counts of Cyrillic, suspect, word and control characters."""
    return F.struct(
        F.regexp_count(text, F.lit(CYRILLIC)).alias("cyrillic"), F.regexp_count(text, F.lit(SUSPECT)).alias("latin1_suspect"),
        F.regexp_count(text, F.lit(ANY_WORD)).alias("word_chars"), F.regexp_count(text, F.lit(CONTROL)).alias("controls"),
    )


_C0 = "".join(chr(k) for k in range(0x20) if chr(k) not in "\n\r\t\f")
_C1 = "".join(map(chr, range(0x80, 0xA0)))


def strip_controls(text: Column) -> Column:
    """Form feeds to newlines, other control characters to spaces."""
    return F.translate(text, "\f" + _C0 + _C1, "\n" + " " * len(_C0 + _C1))


def _unbroken(text: Column) -> Column:
    special = {"\x1c": "Р", "\x1d": "ф", "\x9f": "§", "\f": "\n"}
    plain = "".join(c for c in _C0 if c not in special)
    high = "".join(c for c in _HIGH if c not in special)
    page = "".join(p for c, p in zip(_HIGH, _PAGE, strict=True) if c not in special)
    return F.translate(text, "".join(special) + plain + high, "".join(special.values()) + " " * len(plain) + page)


def repair_mojibake(text: Column) -> Column:
    """Code-page text that was read as Latin-1 is mapped back where that yields Cyrillic."""
    before, fixed_text = quality(text), _unbroken(text)
    suspect, cyrillic = before["latin1_suspect"], before["cyrillic"]
    better = F.regexp_count(fixed_text, F.lit(CYRILLIC)) > cyrillic + F.floor(suspect / 2)
    return strip_controls(F.when((suspect >= 8) & (suspect > cyrillic * 2) & better, fixed_text).otherwise(text))


def clean_pdf_text(text: Column) -> Column:
    """Repaired text; empty unless it has 3 terms, 12 word characters and few control characters."""
    t = newlines(repair_mojibake(text))
    q = quality(t)
    tokens = F.size(terms(t))
    useful = (tokens >= 3) & (q["word_chars"] >= 12) & (q["controls"] <= F.floor(q["word_chars"] / 3) + 20)
    return F.when(useful, t).otherwise("")


def count_substring(text: Column, needle: str) -> Column:
    """Occurrences of needle that do not overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def pdf_probe(content: Column, size: Column | None = None) -> Column:
    """Markers in the first bytes of a PDF, and what they say of the extractors to try."""
    size = F.length(content).cast("long") if size is None else size
    prefix = F.least(F.lit(PREFIX_BYTES), F.when(size <= 2 * MIB, size).otherwise(768 * 1024))
    s = F.decode(F.substring(content, F.lit(1), prefix.cast("int")), "ISO-8859-1")
    images = count_substring(s, "/Subtype /Image") + count_substring(s, "/Image")
    fonts = count_substring(s, "/Font")
    texts = sum((count_substring(s, x) for x in (" BT", "\nBT", " Tj", " TJ")), F.floor(count_substring(s, "'") / 4).cast("long"))
    textual = (fonts > 0) | (texts > 0)
    scanned = (size >= 4 * MIB) & (images >= 4) & (texts == 0) & (fonts == 0)

    def tier(huge: int, large: int, medium: int, default: int) -> Column:
        return F.when(size >= 64 * MIB, huge).when(size >= 16 * MIB, large).when(size >= 8 * MIB, medium).otherwise(default)

    return F.struct(
        size.alias("size"), images.alias("image_markers"), fonts.alias("font_markers"), texts.alias("text_markers"),
        count_substring(s, "/Type /Page").alias("page_markers"), textual.alias("likely_textual"), scanned.alias("likely_scanned"),
        tier(3500, 5000, 7000, 10000).alias("first_timeout_ms"), tier(2500, 3500, 4500, 7000).alias("second_timeout_ms"),
        tier(8 * MIB, 10 * MIB, 12 * MIB, 16 * MIB).alias("max_output_bytes"),
        (~scanned & (textual | (size <= 6 * MIB))).alias("try_second"), ((size <= 2 * MIB) & textual).alias("try_fallback"),
    )


def stable_hash(text: Column) -> Column:
    """A key for names of cached files."""
    return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


