"""One query opN_<name> for each corpus operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.llm import html, langid, lines, packing, pieces, quality, simhash, suffixes, topk, urls
from lantern.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_simhash_near_dedup, op3_url_filters, op4_sentencepiece, op5_exact_top_k, op6_quality_rules,
        op7_best_fit_packing, op8_html_extraction, op9_line_dedup, op10_suffix_array_dedup,
    )
}



def _url_sql() -> str:
    """The URL rules as SQL: the longest that fits, else the host globs as regular expressions."""
    order = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, order, strict=True))
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in order)
    globs = ("".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else f"\\{c}") for c in g) for g in urls.BLOCK_HOSTS)
    hits = " + ".join(f"CAST(regexp_full_match('.' || host, '(?s){g}') AS INTEGER)" for g in globs)
    return f"""
        WITH parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), ruled AS (SELECT *, CASE {rule} END AS rule, {hits} AS globs_hit FROM parts)
        SELECT page_id, host, path, rule, CASE {verdict} WHEN globs_hit > 0 THEN 'block' ELSE 'allow' END AS verdict, globs_hit FROM ruled
    """


ORACLES: dict[str, str] = {
    "op3_url_filters": _url_sql(),
    "op5_exact_top_k": """
        WITH ok AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM ok q, ok c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents
        ), cut AS (
            SELECT doc_id, pos, line AS whole, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, source
            FROM lines
        ), wide AS (
            SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM cut
            WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5
        ), told AS (
            SELECT c.doc_id, c.pos, c.whole,
                   w.line IS NOT NULL AND NOT (w.first.d = c.doc_id AND w.first.p = c.pos) AS gone
            FROM cut c LEFT JOIN wide w ON w.line = c.line
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               md5(coalesce(string_agg(whole, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
        FROM told GROUP BY doc_id
    """,
}
