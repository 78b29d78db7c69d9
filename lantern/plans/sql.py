"""The SQL that registered queries are compared with, put together from the same fixed values."""

from __future__ import annotations

from lantern.functions import fixed
from lantern.functions.terms import ENGLISH, LOWER, RUSSIAN, UPPER, WORD, alias_pairs
from lantern.operators.search import doc_limit, segment_limit

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
LIMIT = 8


def fold(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def raw(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '{WORD}')"


def stem(x: str) -> str:
    back = "\\1"
    return f"regexp_replace(regexp_replace({x}, '{RUSSIAN}', '{back}'), '{ENGLISH}', '{back}')"


def norm(x: str) -> str:
    s = stem(x)
    return f"CASE WHEN {x} NOT IN ({_STOPS}) AND strlen({s}) > 1 AND {s} NOT IN ({_STOPS}) THEN {s} END"


CORPUS = """corpus AS (
    SELECT doc_id, '/corpus/' || source || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS title,
           '.txt' AS type, coalesce(text, '') AS text FROM documents)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


#: Text to atoms that end at a boundary character, joined again until they have 80 bytes.
def _sentences(x: str) -> str:
    atoms = f"regexp_extract_all({x}, '[^.!?;\\n]*[.!?;\\n]|[^.!?;\\n]+')"
    items = f"list_transform({atoms}, lambda s: {{'done': CAST([] AS VARCHAR[]), 'cur': s}})"
    step = (
        f"lambda a, b: CASE WHEN strlen(a.cur) >= {fixed.SENTENCE_BYTES} AND regexp_matches(a.cur, '[.!?;\\n]$') "
        "THEN {'done': list_append(a.done, a.cur), 'cur': b.cur} ELSE {'done': a.done, 'cur': a.cur || b.cur} END"
    )
    folded = f"list_reduce({items}, {step})"
    return f"list_filter(list_transform(list_append(({folded}).done, ({folded}).cur), lambda s: trim(s, {BLANKS})), lambda s: s <> '')"


UNITS = (
    f"""paras AS (
    SELECT doc_id, k, trim(p, {BLANKS}) AS p FROM (
        SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n([ \\t\\f\\v]*(\\n|$))+')) AS p,
               generate_subscripts(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n([ \\t\\f\\v]*(\\n|$))+'), 1) AS k FROM corpus)
    WHERE trim(p, {BLANKS}) <> '')""",
    f"""unit_lists AS (
    SELECT doc_id, flatten(list(CASE WHEN strlen(p) <= {fixed.FRAGMENT_BYTES} THEN [p] ELSE {_sentences('p')} END ORDER BY k)) AS units
    FROM paras GROUP BY doc_id)""",
)
_EMPTY = "{'done': CAST([] AS VARCHAR[]), 'cur': '', 'hard': false}"
_PACK_STEP = (
    "lambda a, b: CASE WHEN b.hard THEN {'done': list_append(CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, b.cur), 'cur': '', 'hard': false} "
    f"WHEN a.cur <> '' AND strlen(a.cur) + strlen(b.cur) + 2 > {fixed.FRAGMENT_BYTES} THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'hard': false}} "
    "ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN b.cur ELSE a.cur || chr(10) || chr(10) || b.cur END, 'hard': false} END"
)
#: A unit over the limit is cut by characters here, so the comparison holds where it is ASCII.
_ITEMS = (
    f"flatten(list_transform(units, lambda u: CASE WHEN strlen(u) <= {fixed.FRAGMENT_BYTES} THEN [{{'done': CAST([] AS VARCHAR[]), 'cur': u, 'hard': false}}] "
    f"ELSE list_transform(regexp_extract_all(u, '(?s).{{1,{fixed.FRAGMENT_BYTES // 2}}}.{{0,{fixed.FRAGMENT_BYTES // 2}}}'), "
    f"lambda p: {{'done': CAST([] AS VARCHAR[]), 'cur': trim(p, {BLANKS}), 'hard': true}}) END))"
)
FRAGMENTS = (
    *UNITS,
    f"""packed AS (
    SELECT doc_id, CASE WHEN x.cur = '' THEN x.done ELSE list_append(x.done, x.cur) END AS parts
    FROM (SELECT doc_id, list_reduce(list_prepend({_EMPTY}, {_ITEMS}), {_PACK_STEP}) AS x FROM unit_lists))""",
    f"""parts AS (
    SELECT c.doc_id, 0 AS k, '{fixed.META_NAME}' || title || chr(10) || '{fixed.META_TITLE}' || regexp_replace(title, '\\.[^.]*$', '') || chr(10)
           || '{fixed.META_PATH}' || path || chr(10) || '{fixed.META_TYPE}' || type || chr(10)
           || CASE WHEN trim(text, {BLANKS}) = '' THEN '{fixed.META_NO_TEXT}' ELSE '' END AS text FROM corpus c
    UNION ALL
    SELECT doc_id, generate_subscripts(parts, 1) AS k, trim(unnest(parts), {BLANKS}) AS text FROM packed)""",
    f"parts_raw AS (SELECT doc_id, k, unnest({raw('text')}) AS raw FROM parts)",
    "words AS (SELECT raw, " + norm("raw") + " AS term FROM (SELECT DISTINCT raw FROM parts_raw))",
    "part_terms AS (SELECT doc_id, k, term, count(*) AS tf FROM parts_raw JOIN words USING (raw) WHERE term IS NOT NULL GROUP BY ALL)",
    """lengths AS (SELECT doc_id, k, CAST(sum(tf) AS BIGINT) AS length FROM part_terms GROUP BY ALL)""",
    """frags AS (SELECT doc_id, k, length, text, k = 0 AS metadata_only,
           row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ordinal,
           row_number() OVER (ORDER BY doc_id, k) - 1 AS fragment_id FROM lengths JOIN parts USING (doc_id, k))""",
    "posts AS (SELECT term, fragment_id, doc_id, tf FROM part_terms JOIN frags USING (doc_id, k))",
    "dposts AS (SELECT term, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM posts GROUP BY ALL)",
    """docs AS (SELECT c.doc_id, path, title, type, CAST(coalesce(sum(f.length), 0) AS BIGINT) AS length, count(f.k) AS fragment_count,
           coalesce(min(fragment_id), (SELECT count(*) FROM frags)) AS first_fragment_id
           FROM corpus c LEFT JOIN frags f USING (doc_id) GROUP BY c.doc_id, path, title, type)""",
    """stats AS (SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM frags) AS n_fragments,
           (SELECT avg(length) FROM docs) AS avg_doc_len, (SELECT avg(length) FROM frags) AS avg_fragment_len)""",
)
SEGMENTS = (
    "ordered AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, fragment_count FROM docs)",
    f"""seg_walk AS (
    SELECT rn, doc_id, CAST(0 AS BIGINT) AS segment_id, CAST(1 AS BIGINT) AS d, CAST(fragment_count AS BIGINT) AS f FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.rn, o.doc_id, w.segment_id + CAST(w.d >= {fixed.SEGMENT_DOCS} OR w.f + o.fragment_count > {fixed.SEGMENT_FRAGMENTS} AS BIGINT),
           CASE WHEN w.d >= {fixed.SEGMENT_DOCS} OR w.f + o.fragment_count > {fixed.SEGMENT_FRAGMENTS} THEN 1 ELSE w.d + 1 END,
           CASE WHEN w.d >= {fixed.SEGMENT_DOCS} OR w.f + o.fragment_count > {fixed.SEGMENT_FRAGMENTS} THEN o.fragment_count ELSE w.f + o.fragment_count END
    FROM seg_walk w JOIN ordered o ON o.rn = w.rn + 1)""",
    "doc_segments AS (SELECT doc_id, segment_id FROM seg_walk)",
)
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in alias_pairs())
QUERY = (
    f"q_raw AS (SELECT item_id AS qid, unnest({raw('text')}) AS raw, generate_subscripts({raw('text')}, 1) AS k FROM benchmark)",
    "q_words AS (SELECT raw, " + norm("raw") + " AS term FROM (SELECT DISTINCT raw FROM q_raw))",
    "q_first AS (SELECT qid, term, min(k) AS k FROM q_raw JOIN q_words USING (raw) WHERE term IS NOT NULL GROUP BY ALL)",
    "base AS (SELECT qid, term, CAST(row_number() OVER (PARTITION BY qid ORDER BY k) - 1 AS INTEGER) AS pos FROM q_first)",
    f"aliases(term, alias) AS (VALUES {_PAIRS})",
    f"""expanded AS (SELECT qid, term, max(weight) AS weight FROM (
        SELECT qid, term, CAST(1.0 AS DOUBLE) AS weight FROM base
        UNION ALL SELECT qid, alias, CAST({fixed.ALIAS_WEIGHT} AS DOUBLE) FROM base JOIN aliases USING (term)) GROUP BY ALL)""",
    f"folded AS (SELECT item_id AS qid, trim({fold('text')}, {BLANKS}) AS folded FROM benchmark)",
    "n_base AS (SELECT qid, count(*) AS n FROM base GROUP BY qid)",
)


def _bm25(n: str, length: str, mean: str) -> str:
    return (
        f"weight * ln(1.0 + ({n} - df + 0.5) / (df + 0.5)) * (tf * {fixed.K1 + 1.0!r} / (tf + {fixed.K1} * ({1.0 - fixed.B!r} + {fixed.B} * {length} / {mean})))"
    )


SCORES = (
    "ddf AS (SELECT term, count(*) AS df FROM dposts GROUP BY term)",
    f"""raw_docs AS (SELECT qid, doc_id, sum({_bm25('n_docs', 'length', 'avg_doc_len')}) AS score
        FROM expanded JOIN dposts USING (term) JOIN ddf USING (term) JOIN docs USING (doc_id), stats GROUP BY ALL)""",
    "dcover AS (SELECT qid, doc_id, count(*) AS c FROM base JOIN dposts USING (term) GROUP BY ALL)",
    f"""boosted AS (SELECT r.qid, r.doc_id, score * (0.88 + 0.34 * (coalesce(c, 0) / n))
        + CASE WHEN strlen(folded) >= 4 AND contains({fold('title')}, folded) THEN 2.25 ELSE 0 END
        + CASE WHEN strlen(folded) >= 4 AND contains({fold('path')}, folded) THEN 1.0 ELSE 0 END AS score
        FROM raw_docs r LEFT JOIN dcover USING (qid, doc_id) JOIN docs USING (doc_id) JOIN folded USING (qid) JOIN n_base USING (qid))""",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM boosted WHERE score > 0)",
)
STAGE2 = (
    f"seg_scores AS (SELECT qid, segment_id, sum(score) AS score FROM ranked JOIN doc_segments USING (doc_id) WHERE place <= {doc_limit(LIMIT)} GROUP BY ALL)",
    f"""top_segments AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, segment_id) AS place FROM seg_scores)
        WHERE place <= {segment_limit(LIMIT)})""",
    f"""cands AS (SELECT qid, doc_id, doc_score FROM (
        SELECT r.qid, doc_id, r.score AS doc_score, row_number() OVER (PARTITION BY r.qid ORDER BY r.place) AS again
        FROM ranked r JOIN doc_segments USING (doc_id) SEMI JOIN top_segments t ON t.qid = r.qid AND t.segment_id = doc_segments.segment_id)
        WHERE again <= {doc_limit(LIMIT)})""",
    "fdf AS (SELECT term, count(*) AS df FROM posts GROUP BY term)",
    f"""raw_frags AS (SELECT qid, fragment_id, p.doc_id, doc_score, sum({_bm25('n_fragments', 'f.length', 'avg_fragment_len')}) AS score
        FROM expanded JOIN posts p USING (term) JOIN cands c USING (qid, doc_id) JOIN fdf USING (term) JOIN frags f USING (fragment_id), stats GROUP BY ALL)""",
    "fcover AS (SELECT qid, fragment_id, count(*) AS c FROM base JOIN posts USING (term) GROUP BY ALL)",
    f"""boosted_frags AS (SELECT qid, fragment_id, r.doc_id,
        (score * (0.85 + 0.30 * (coalesce(c, 0) / n)) + doc_score * CASE WHEN metadata_only THEN 0.10 ELSE 0.18 END
         + CASE WHEN strlen(folded) >= 4 AND contains({fold('f.text')}, folded) THEN 1.25 ELSE 0 END)
        * CASE WHEN metadata_only THEN 0.72 ELSE 1.0 END
        + CASE WHEN metadata_only AND strlen(folded) >= 3 AND contains({fold('title')}, folded) THEN 3.0 ELSE 0 END AS score
        FROM raw_frags r LEFT JOIN fcover USING (qid, fragment_id) JOIN frags f USING (fragment_id) JOIN docs d ON d.doc_id = r.doc_id
        JOIN folded USING (qid) JOIN n_base USING (qid))""",
    f"""results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, fragment_id) AS place
        FROM boosted_frags WHERE score > 0) WHERE place <= {LIMIT})""",
)
_GRAMS = "list_distinct(list_transform(range(1, greatest(2, length({0}) - 1)), lambda k: substring({0}, k, 3)))"


def grams(x: str) -> str:
    return _GRAMS.format(x)


#: The SQL engine's edit distance counts bytes; letters beyond ASCII that the tables hold get one byte each.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüàâáúîôûëïù" + "".join(map(chr, range(0x430, 0x450)))
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_`{|}~" + "".join(map(chr, range(1, 9)))


def narrow(x: str) -> str:
    return f"translate({x}, '{_WIDE}', '{_NARROW}')"


_DISTANCE = f"levenshtein({narrow('term')}, {narrow('candidate')})"
FUZZY = (
    f"vgrams AS (SELECT DISTINCT unnest({grams('term')}) AS gram, term AS candidate FROM (SELECT DISTINCT term FROM dposts))",
    f"asked AS (SELECT term, unnest({grams('term')}) AS gram FROM (SELECT DISTINCT term FROM base WHERE length(term) >= 4))",
    "shared AS (SELECT term, candidate, count(*) AS overlap FROM asked JOIN vgrams USING (gram) GROUP BY ALL)",
    f"""near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY overlap DESC, candidate) AS INTEGER) AS place FROM shared)
        WHERE place <= {fixed.FUZZY_CANDIDATES})""",
    f"""matched AS (SELECT term, candidate, place, {_DISTANCE} AS distance,
        CASE WHEN {_DISTANCE} = 1 THEN CAST({fixed.ONE_EDIT_WEIGHT} AS DOUBLE) ELSE CAST({fixed.TWO_EDIT_WEIGHT} AS DOUBLE) END AS weight FROM near
        WHERE abs(length(term) - length(candidate)) <= CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END
          AND (left(term, 1) = left(candidate, 1) OR right(term, 1) = right(candidate, 1))
          AND (len({grams('term')}) < 3 OR overlap >= 2)
          AND {_DISTANCE} <= CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END)""",
    """fz_rows AS (SELECT qid, list({'pos': pos, 'cand': candidate, 'w': weight, 'out': CAST([] AS STRUCT(term VARCHAR, weight DOUBLE)[]), 'known': CAST([] AS VARCHAR[]), 'added': 0}
        ORDER BY pos, place) AS rows FROM base JOIN matched USING (term) GROUP BY qid)""",
    "fz_known AS (SELECT qid, list(term) AS known FROM expanded GROUP BY qid)",
    f"""fz_fold AS (SELECT qid, list_reduce(list_prepend({{'pos': -1, 'cand': '', 'w': CAST(0 AS DOUBLE), 'out': CAST([] AS STRUCT(term VARCHAR, weight DOUBLE)[]), 'known': known, 'added': 0}}, rows),
        lambda a, b: CASE WHEN NOT list_contains(a.known, b.cand) AND (a.pos <> b.pos OR a.added < {fixed.FUZZY_ADDED})
            THEN {{'pos': b.pos, 'cand': b.cand, 'w': b.w, 'out': list_append(a.out, {{'term': b.cand, 'weight': b.w}}), 'known': list_append(a.known, b.cand),
                   'added': CASE WHEN a.pos = b.pos THEN a.added + 1 ELSE 1 END}}
            ELSE {{'pos': b.pos, 'cand': b.cand, 'w': b.w, 'out': a.out, 'known': a.known, 'added': CASE WHEN a.pos = b.pos THEN a.added ELSE 0 END}} END) AS x
        FROM fz_rows JOIN fz_known USING (qid))""",
    "fuzzy AS (SELECT qid, u.term, u.weight FROM (SELECT qid, unnest(x.out) AS u FROM fz_fold))",
)
INDEX = (CORPUS, *FRAGMENTS)
TASKS = """tasks AS (SELECT o_orderkey AS task_id, 'order ' || o_orderkey AS title, CAST(o_orderkey % 5 + 1 AS INTEGER) AS difficulty,
    6 - CAST(o_orderpriority[1] AS INTEGER) AS urgency, CAST(o_custkey % 90 + 1 AS INTEGER) AS duration_minutes,
    o_orderstatus = 'F' AS completed, o_orderkey AS pos FROM orders),
    prioritised AS (SELECT *, urgency * 2 + difficulty + CASE WHEN duration_minutes <= 15 THEN 3 WHEN duration_minutes <= 30 THEN 2
        WHEN duration_minutes <= 60 THEN 1 ELSE 0 END AS priority FROM tasks)"""
TASK_ORDER = "completed, priority DESC, urgency DESC, duration_minutes, pos"
REASON = f"""coalesce(nullif(concat_ws('{fixed.REASON_AND}',
    CASE WHEN urgency >= 4 THEN '{fixed.REASON_URGENT}' WHEN urgency >= 2 THEN '{fixed.REASON_MEDIUM}' END,
    CASE WHEN difficulty >= 4 THEN '{fixed.REASON_HARD}' END,
    CASE WHEN duration_minutes <= 30 THEN '{fixed.REASON_SHORT}' || duration_minutes || '{fixed.REASON_SHORT_END}'
         WHEN duration_minutes <= 60 THEN '{fixed.REASON_HOUR}' END), ''), '{fixed.REASON_DEFAULT}')"""
TIP = f"""CASE WHEN duration_minutes <= 20 THEN '{fixed.TIP_SHORT}' WHEN difficulty >= 4 THEN '{fixed.TIP_HARD}' ELSE '{fixed.TIP_DEFAULT}' END"""
SENTENCES = _sentences
