"""Commands: build, search, query and interactive, over an index folder.

python -m lantern.cli build FOLDER [-o INDEX] [-j N]
python -m lantern.cli search INDEX WORDS... [-n N] [--answer] [--no-color]
python -m lantern.cli query FOLDER WORDS... [-n N] [--answer] [--no-color]
python -m lantern.cli interactive INDEX [-n N] [--answer] [--no-color]
python -m lantern.cli tasks [FILE]
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lantern.functions import fixed
from lantern.functions.terms import BLANKS
from lantern.operators import cache, index, present, search, tasks

DEFAULT_INDEX = "lantern.idx"


@dataclass
class Options:
    limit: int = 8
    threads: int = 0
    answer: bool = False
    colour: bool = True
    output: str = DEFAULT_INDEX
    words: list[str] = field(default_factory=list)

    @property
    def query(self) -> str:
        return " ".join(self.words)


def _at_least_one(text: str) -> int:
    """The number a text starts with; one if there is none or it is less."""
    digits = text.strip()
    sign = digits[:1] in "+-" and digits[:1]
    digits = digits[1:] if sign else digits
    n = len(digits) - len(digits.lstrip("0123456789"))
    return max(1, int(digits[:n])) if n and sign != "-" else 1


def parse(args: list[str]) -> Options:
    out = Options()
    rest = iter(args)
    for a in rest:
        if a in ("-n", "--limit", "-j", "--threads", "-o", "--output"):
            value = next(rest, None)
            if value is None:
                out.words.append(a)
            elif a in ("-n", "--limit"):
                out.limit = _at_least_one(value)
            elif a in ("-j", "--threads"):
                out.threads = _at_least_one(value)
            else:
                out.output = value
        elif a == "--answer":
            out.answer = True
        elif a == "--no-color":
            out.colour = False
        else:
            out.words.append(a)
    return out


def default_threads(asked: int) -> int:
    return asked or min(8, max(1, os.cpu_count() or 4))


def session(threads: int = 0) -> SparkSession:
    n = default_threads(threads)
    return SparkSession.builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", n).config("spark.ui.enabled", "false").getOrCreate()


def answer_text(spark: SparkSession, ix: index.Index, o: Options, query: str) -> str:
    q = spark.createDataFrame([(0, query)], "qid long, text string")
    found = search.search(ix, q, o.limit).cache()
    lines = [r["line"] for r in present.printed(present.present(ix, q, found, o.colour)).orderBy("place").collect()]
    if not lines:
        return fixed.NOTHING_FOUND
    out = ["\n" + x for x in lines]
    if o.answer:
        rows = present.answers(ix, q, found).orderBy("place").collect()
        out += ["", fixed.ANSWER_HEAD, *(f"- {r['answer']} [{k}]" for k, r in enumerate(rows, 1))]
        out += ["", fixed.SOURCES_HEAD, *(f"[{k}] {r['source']}" for k, r in enumerate(rows, 1))]
    return "\n".join(out)


def main(args: list[str]) -> int:
    """0 for success, 1 for a command that failed or is not known, 2 for an exception."""
    try:
        return _run(args)
    except Exception as e:  # noqa: BLE001
        print(f"Error: {e}", file=sys.stderr)
        return 2


def _run(args: list[str]) -> int:
    for stream in (sys.stdin, sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")
    verb, rest = (args[0], args[1:]) if args else ("", [])
    if verb == "tasks":
        tasks.menu(session(1), rest[0] if rest else tasks.DEFAULT_FILE)
        return 0
    if verb not in ("build", "search", "query", "interactive") or not rest or verb in ("search", "query") and len(rest) < 2:
        print(__doc__)
        return 1
    o = parse(rest[1:])
    if verb in ("search", "query") and not o.query.strip(BLANKS):
        print("Empty query.", file=sys.stderr)
        return 1
    spark = session(o.threads)
    if verb in ("build", "query"):
        ix, seen = cache.build_folder(spark, rest[0])
        if ix is None:
            print("Index is empty. Check document folder and supported formats.", file=sys.stderr)
            return 1
        if verb == "build":
            ix.save(o.output)
            print(f"Cache hits {seen['cache_hits']}/{seen['files']}")
            print(f"{o.output}: {index.Index.load(spark, o.output).counts()}")
            return 0
    else:
        ix = index.Index.load(spark, rest[0])
    if verb != "interactive":
        print(answer_text(spark, ix, o, o.query))
        return 0
    print(f"Loaded {ix.counts()}. Type query, or :q to exit.")
    while True:
        try:
            query = input("\nsearch> ").strip(BLANKS)
        except EOFError:
            return 0
        if query in (":q", ":quit", "exit"):
            return 0
        if query:
            print(answer_text(spark, ix, o, query))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
