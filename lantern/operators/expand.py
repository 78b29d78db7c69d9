"""Query expansion: aliases and fuzzy terms, for a batch of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import fixed
from lantern.functions.terms import aliases, grams, query_terms


def base_terms(queries: DataFrame) -> DataFrame:
    """qid, pos, term: the distinct terms of each query (qid, text) by first occurrence."""
    return queries.select("qid", F.posexplode(query_terms("text")).alias("pos", "term"))


def alias_expand(base: DataFrame) -> DataFrame:
    """qid, term, weight: base terms with 1.0, their aliases with 0.62, the most of each."""
    table = F.broadcast(aliases(base.sparkSession))  # a fixed word list
    own = base.select("qid", "term", F.lit(1.0).alias("weight"))
    other = base.join(table, "term").select("qid", F.col("alias").alias("term"), F.lit(fixed.ALIAS_WEIGHT).alias("weight"))
    return own.unionByName(other).groupBy("qid", "term").agg(F.max("weight").alias("weight"))


def edit_limit(term: Column) -> Column:
    return F.when(F.length(term) <= 6, 1).otherwise(2)


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """The edit distance, or limit + 1 if it is greater."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def fuzzy_candidates(base: DataFrame, vocab_grams: DataFrame) -> DataFrame:
    """term, candidate, overlap, place: the vocabulary's words by shared 3-grams, 256 of each term.

    Works on distinct terms, however many queries hold them. Ties of overlap go by word."""
    asked = base.where(F.length("term") >= 4).select("term").distinct()
    given = asked.select("term", F.explode(grams(F.col("term"))).alias("gram"))
    shared = given.join(vocab_grams.select("gram", F.col("term").alias("candidate")), "gram").groupBy("term", "candidate").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("overlap"), "candidate"))
    return shared.withColumn("place", place).where(F.col("place") <= fixed.FUZZY_CANDIDATES)


def fuzzy_matches(candidates: DataFrame) -> DataFrame:
    """candidates that pass the length, end, overlap and distance tests, with their weight."""
    t, c = F.col("term"), F.col("candidate")
    limit = edit_limit(t)
    near = F.when(F.length(t) <= 6, bounded_distance(t, c, 1)).otherwise(bounded_distance(t, c, 2))
    ends = (F.substring(t, 1, 1) == F.substring(c, 1, 1)) | (F.substring(t, -1, 1) == F.substring(c, -1, 1))
    enough = (F.size(grams(t)) < 3) | (F.col("overlap") >= 2)
    rows = candidates.where((F.abs(F.length(t) - F.length(c)) <= limit) & ends & enough).withColumn("distance", near)
    return rows.where(F.col("distance") <= limit).withColumn(
        "weight", F.when(F.col("distance") == 1, fixed.ONE_EDIT_WEIGHT).otherwise(fixed.TWO_EDIT_WEIGHT)
    )


def fuzzy_expand(base: DataFrame, vocab_grams: DataFrame) -> DataFrame:
    """qid, term, weight of the words that fuzzy matching adds to the alias expansion.

    The rule is sequential in a query: a word that is there already, from an alias or an earlier
    term, is passed over and does not use up the ten of a term. It is a fold over each query's
    matches (at most 256 per term) in order of term and place."""
    matches = fuzzy_matches(fuzzy_candidates(base, vocab_grams))
    known = alias_expand(base).groupBy("qid").agg(F.collect_set("term").alias("known"))
    rows = (
        base.join(matches, "term").groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "place", "candidate", "weight"))).alias("rows")).join(known, "qid")
    )
    start = F.struct(
        F.array().cast("array<struct<term:string,weight:double>>").alias("out"), F.col("known").alias("known"),
        F.lit(-1).alias("pos"), F.lit(0).alias("added"),
    )

    def step(a: Column, r: Column) -> Column:
        added = F.when(a["pos"] == r["pos"], a["added"]).otherwise(0)
        take = ~F.array_contains(a["known"], r["candidate"]) & (added < fixed.FUZZY_ADDED)
        new = F.struct(r["candidate"].alias("term"), r["weight"].cast("double").alias("weight"))
        return F.struct(
            F.when(take, F.concat(a["out"], F.array(new))).otherwise(a["out"]).alias("out"),
            F.when(take, F.concat(a["known"], F.array(r["candidate"]))).otherwise(a["known"]).alias("known"),
            r["pos"].alias("pos"), (added + take.cast("int")).alias("added"),
        )

    return rows.select("qid", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).select("qid", "x.term", "x.weight")


def expand(base: DataFrame, vocab_grams: DataFrame | None) -> DataFrame:
    """qid, term, weight of a batch; without vocab_grams aliases alone expand."""
    out = alias_expand(base)
    if vocab_grams is not None:
        out = out.unionByName(fuzzy_expand(base, vocab_grams))
    return out.groupBy("qid", "term").agg(F.max("weight").alias("weight"))
