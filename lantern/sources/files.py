"""A folder of documents as a table: listing, bytes, text by file type.

Paths are listed on the driver (names and sizes only), because the readers hide files whose
names start with a dot or an underscore; bytes are read by the executors' own open(). Both need a
file system that is mounted on all machines.
"""

from __future__ import annotations

import io
import os
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import fixed
from lantern.functions.decode import clean_pdf_text, docx_xml_text, newlines, pdf_probe, strip_markdown, text_of_bytes
from lantern.functions.terms import trim

_DOCX_PART = re.compile(r"word/(document|footnotes|endnotes|comments|header[0-9]+|footer[0-9]+)\.xml")
ENOUGH_BYTES, FALLBACK_BYTES, LITERAL_BYTES = 20, 40, 3


def is_skipped(directory: str) -> bool:
    return directory.lower() in (*fixed.SKIPPED_DIRECTORIES, fixed.CACHE_DIRECTORY)


def extension(name: str) -> str:
    """The last extension in ASCII lower case; a leading dot begins a name, not an extension."""
    return os.path.splitext(name)[1].lower()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_key, title, type, size, mtime of the supported files under root, by path."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    rows = []
    for at, directories, names in os.walk(root):
        directories[:] = sorted(d for d in directories if not is_skipped(d))
        for name in names:
            path = os.path.join(at, name)
            if extension(name) in fixed.EXTENSIONS and os.path.isfile(path):
                info = os.stat(path)
                rows.append((path, os.path.relpath(path, root), name, extension(name), info.st_size, info.st_mtime_ns))
    return spark.createDataFrame(sorted(rows), "path string, rel_key string, title string, type string, size long, mtime long")


def read_bytes(files: DataFrame) -> DataFrame:
    """files with content (null if unreadable); one file at a time per task."""
    schema = files.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(len(b)):
                row = b.iloc[k : k + 1]
                try:
                    with open(row["path"].iloc[0], "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield row.assign(content=[content])

    width = max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(width).mapInPandas(run, ", ".join(x.replace(":", " ", 1) for x in schema.split(",")) + ", content binary")


def docx_xml(content: bytes) -> str:
    """The text parts of a DOCX as XML, each followed by a newline; empty if it is no archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return "".join(z.read(n).decode("utf-8", "replace") + "\n" for n in z.namelist() if _DOCX_PART.fullmatch(n))
    except (zipfile.BadZipFile, KeyError, RuntimeError, OSError):
        return ""


_PAGE = {k: fixed.CODE_PAGE.get(k, "?") for k in range(0x80, 0xC0)} | {k: chr(0x350 + k) for k in range(0xC0, 0x100)}


def pdf_string(data: bytes) -> str:
    """A PDF string's bytes as text: UTF-16 with a mark, UTF-8, else the code page."""
    for mark, name in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            return data[2 : len(data) - len(data) % 2].decode(name, "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1").translate(_PAGE)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_LITERAL = re.compile(rb"\\([0-7]{1,3}|\r\n|.)|([()])|[^\\()]+", re.S)


def pdf_literal(data: bytes, at: int) -> tuple[str, int]:
    """The string that opens at data[at] == ( and where it ends; parentheses may nest."""
    out, depth, at = [], 1, at + 1
    while depth and at < len(data):
        m = _LITERAL.match(data, at)
        if m is None:  # a lone backslash at the end
            out.append(data[at : at + 1])
            at += 1
            continue
        at = m.end()
        if m[1] is not None:
            octal = m[1][:1].isdigit() and m[1][:1] < b"8"
            out.append(bytes([int(m[1], 8) & 255]) if octal else _ESCAPES.get(m[1], m[1]))
        elif m[2] is not None:
            depth += 1 if m[2] == b"(" else -1
            if depth:
                out.append(m[2])
        else:
            out.append(m[0])
    return pdf_string(b"".join(out)), at


def pdf_hex(data: bytes, at: int) -> tuple[str, int]:
    """The hexadecimal string that opens at data[at] == <; a last odd digit counts as if 0 followed."""
    end = data.find(b">", at)
    inner = data[at + 1 : end if end >= 0 else len(data)]
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", inner)
    return pdf_string(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), (end + 1 if end >= 0 else len(data))


#: What matters of a text section: strings, dictionaries (passed over) and the operators that begin a line.
_TEXT_MARKS, _LITERAL_MARKS = re.compile(rb"<<|[(<*'\"]"), re.compile(rb"\(")
_TEXT_SECTIONS = re.compile(rb"BT.*?ET", re.S).finditer


def pdf_strings(data: bytes, marks: re.Pattern[bytes], begin: int, end: int) -> Iterator[str | None]:
    """The strings that open at a mark from begin to end, in order; None for a new line."""
    at = begin
    while mark := marks.search(data, at, end):
        at = mark.end()
        if mark[0] == b"(":
            text, at = pdf_literal(data, mark.start())
            yield text
        elif mark[0] == b"<":
            text, at = pdf_hex(data, mark.start())
            yield text
        elif mark[0] != b"<<":
            yield None


def pdf_plain_text(data: bytes) -> str:
    """Text of the strings between BT and ET of an uncompressed PDF; if that is next to nothing, of
    all literal strings."""
    sections = []
    for section in _TEXT_SECTIONS(data):
        strings = pdf_strings(data, _TEXT_MARKS, section.start() + 2, section.end() - 2)
        sections.append("".join("\n" if x is None else x and x + " " for x in strings) + "\n")
    text = "".join(sections)
    if len(text.encode("utf-8", "replace")) < FALLBACK_BYTES:
        literals = pdf_strings(data, _LITERAL_MARKS, 0, len(data))
        text += "".join(x + "\n" for x in literals if x and len(x.encode("utf-8", "replace")) >= LITERAL_BYTES)
    return re.sub("\r\n?", "\n", text)


def _tool(command: list[str], data: bytes, timeout_ms: int, cap: int) -> str:
    """What an external extractor prints for a copy of the file; nothing if it is not there, fails or takes too long."""
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        try:
            done = subprocess.run([f.name if x == "{}" else x for x in command], capture_output=True, timeout=timeout_ms / 1000)
        except (OSError, subprocess.TimeoutExpired):
            return ""
    return done.stdout[:cap].decode("utf-8", "replace") if done.returncode == 0 else ""


#: The extractors' command lines, tried in this order.
TOOLS = (["pdftotext", "-layout", "-enc", "UTF-8", "{}", "-"], ["mutool", "draw", "-F", "txt", "-o", "-", "{}"])


def _office_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """DOCX as XML; a PDF's three candidate texts. What fails is told in error."""
    for b in batches:
        rows = []
        for path, kind, content, probe in zip(b["path"], b["type"], b["content"], b["probe"], strict=True):
            data = bytes(content or b"")
            xml, texts, error = "", ["", "", ""], None
            try:
                if kind == ".docx":
                    xml = docx_xml(data)
                else:
                    texts[0] = _tool(TOOLS[0], data, probe["first_timeout_ms"], probe["max_output_bytes"])
                    if probe["try_second"]:
                        texts[1] = _tool(TOOLS[1], data, probe["second_timeout_ms"], probe["max_output_bytes"])
                        texts[2] = pdf_plain_text(data) if probe["try_fallback"] else ""
            except Exception as e:  # noqa: BLE001  a document that cannot be read stays, with its name alone
                error = str(e)
            rows.append((path, xml, *texts, error))
        yield pd.DataFrame(rows, columns=["path", "xml", "t1", "t2", "t3", "error"])


def extract_text(files: DataFrame) -> DataFrame:
    """files (path, type, content, ...) -> path, title, type, text, error."""
    own = [c for c in files.columns if c != "content"]
    decoded = newlines(text_of_bytes(F.coalesce("content", F.lit(b""))))
    plain = files.where(F.col("type").isin(".txt", ".text")).select(*own, decoded.alias("text"), F.lit(None).cast("string").alias("error"))
    marked = files.where(F.col("type").isin(".md", ".markdown")).select(*own, strip_markdown(text_of_bytes(F.coalesce("content", F.lit(b"")))).alias("text"), F.lit(None).cast("string").alias("error"))
    office = files.where(F.col("type").isin(".docx", ".pdf")).withColumn("probe", pdf_probe(F.coalesce("content", F.lit(b""))))
    raw = office.select("path", "type", "content", "probe").mapInPandas(_office_texts, "path string, xml string, t1 string, t2 string, t3 string, error string")
    text = F.lit("")
    for name in ("t3", "t2", "t1"):
        cleaned = clean_pdf_text(F.col(name))
        text = cleaned if name == "t3" else F.when(F.octet_length(trim(cleaned)) >= ENOUGH_BYTES, cleaned).otherwise(text)
    read = raw.join(office.select(*own), "path").select(*own, F.when(F.col("type") == ".docx", docx_xml_text(F.col("xml"))).otherwise(text).alias("text"), "error")
    return plain.unionByName(marked).unionByName(read)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """path, title, type, text, error of a folder's documents; null text where nothing was read."""
    return extract_text(read_bytes(list_files(spark, root)))
