"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

The statistics of a text are columns computed within its row (no shuffle). A bounded sample
of labelled rows (SAMPLE, by a hash of the id) is fitted by sequential covering: a rule grows
by the threshold that gains most information on two thirds of what is not yet covered, is
pruned on the other third, and joins the list if it is precise enough there; what it covers
is set aside. The list becomes one ordered CASE WHEN expression: the first rule that fits
rejects, else the text is kept.

Words are runs of `[^\\x20\\x09-\\x0D]`. A null text has no words. Windows of three words are
compared by 64-bit hashes within their text.

Cases: base_failed is true for a null or empty text (under MIN_WORDS words). A document with
several labels counts as bad if one of them is 0; rows with a null label or id are not learned
from. Without labelled rows the list is empty and base_failed alone decides. Ties between
thresholds of one gain go to the feature that FEATURES names first, then to the lower threshold.
A very long text is counted whole, within its row. Repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import SPACES, text_or_empty

MIN_WORDS = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
SAMPLE = 8000
RULES_MAX = 12
CONDITIONS_MAX = 4
PRECISION = 0.9
COVERED_MIN = 5

_GAP = "[ \\t\\n\\x0b\\f\\r]+"

#: What rules may test, in terms of the statistics below.
FEATURES: dict[str, str] = {
    "words": "n_words * 1.0D",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "exclamations": "n_exclaim / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(df: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, and the counts that FEATURES and the base rules use."""
    # Each step is a column of its own, so that no array is computed again inside a lambda.
    text = F.col("__t")
    d = df.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(F.col("text").cast("string")).alias("__t"))
    d = d.select(*keep, "__t", F.array_remove(F.split(text, _GAP), "").alias("__w"), F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("__l"))
    d = d.select(
        *keep, F.size("__w").cast("long").alias("n_words"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"), F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"), _count(text, "!").alias("n_exclaim"), _count(text, "0123456789").alias("n_digits"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    counts = [c for c in d.columns if c != "__h"]
    windows = F.slice(F.transform("__h", lambda h, i: F.xxhash64(h, F.get("__h", i + 1), F.get("__h", i + 2))), 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0)))
    d = d.select(*counts, windows.alias("__v"))
    # Only a text with an equal pair of windows is sorted to find their places.
    placed = F.when(
        F.size(F.array_distinct("__v")) < F.size("__v"), F.sort_array(F.transform("__v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    )
    d = d.select(*counts, placed.alias("__s"))
    again = F.filter("__s", lambda x, k: F.get("__s", k - 1)["v"].eqNullSafe(x["v"]) | F.get("__s", k + 1)["v"].eqNullSafe(x["v"]))
    d = d.select(*counts, again.alias("__s"))
    d = d.select(*counts, F.sort_array(F.transform("__s", lambda x: x["i"])).alias("__p"))
    # A window covers three words, or as many as there are up to the next one that repeats.
    reach = F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]
Row = tuple[dict[str, float], bool]  # features, and whether the text is bad


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def _grow_one(rows: list[Row]) -> Condition | None:
    """The threshold that gains most information about bad rows among rows."""
    bad = sum(y for _, y in rows)
    good = len(rows) - bad
    if not bad or not good:
        return None
    before = math.log2(bad / len(rows))
    best: tuple[float, Condition] | None = None
    for f in FEATURES:
        order = sorted(rows, key=lambda r: r[0][f])
        p = n = 0
        for k, (x, y) in enumerate(order[:-1]):
            p, n = p + y, n + (not y)
            nxt = order[k + 1][0][f]
            if x[f] == nxt:
                continue
            for above, gain in ((False, _gain(p, n, before)), (True, _gain(bad - p, good - n, before))):
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = gain, Condition(f, above, (x[f] + nxt) / 2)
    return best[1] if best else None


def _fits(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def learn(rows: list[Row], precision: float = PRECISION, rules_max: int = RULES_MAX) -> list[Rule]:
    """The decision list; rows come in a fixed order, every third is kept for pruning."""
    out: list[Rule] = []
    left = list(rows)
    while len(out) < rules_max and any(y for _, y in left):
        grow, prune = [r for k, r in enumerate(left) if k % 3], [r for k, r in enumerate(left) if k % 3 == 0]
        rule: Rule = ()
        covered = grow
        while len(rule) < CONDITIONS_MAX and (c := _grow_one(covered)):
            rule += (c,)
            covered = [r for r in covered if c.holds(r[0])]
        best: tuple[float, Rule] = (-1.0, ())
        for k in range(1, len(rule) + 1):
            hit = [y for x, y in prune if _fits(rule[:k], x)]
            p, n = sum(hit), len(hit) - sum(hit)
            worth = (p - n) / (p + n) if hit else -1.0
            if worth > best[0] + 1e-12:
                best = worth, rule[:k]
        rule = best[1]
        hit = [y for x, y in left if rule and _fits(rule, x)]
        if len(hit) < COVERED_MIN or sum(hit) < precision * len(hit) or best[0] < 2 * precision - 1:
            break
        out.append(rule)
        left = [r for r in left if not _fits(rule, r[0])]
    return out


def as_column(rules: Sequence[Rule]) -> Column:
    """True where the list keeps a text: an ordered CASE WHEN over the statistics."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The decision list of a sample of labelled documents; at most sample rows reach the driver."""
    marked = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Bounded by sample rows of two numbers.
    chosen = texts.join(F.broadcast(marked), texts["doc_id"] == marked["label_id"]).select("doc_id", "text", "quality")
    # A filter here would be pushed below the arrays it is made of, and compute them anew.
    found = statistics(chosen, ("doc_id", "quality")).withColumn("failed", base_failed())
    rows = found.select("doc_id", "quality", "failed", *(F.expr(e).alias(f) for f, e in FEATURES.items())).collect()
    rows = [r for r in rows if not r["failed"]]
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], *(r[f] for f in FEATURES)))
    return learn([({f: float(r[f]) for f in FEATURES}, r["quality"] == 0) for r in rows])


def judge(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept."""
    d = statistics(documents)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(as_column(rules)).alias("kept"),
    )


def judge_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents, fit(documents, labels))
