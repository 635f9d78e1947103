"""DuckDB SQL for every named query in ``talkframe.registry`` (the correctness oracle)."""

from __future__ import annotations

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"

SQL: dict = {}


def _tfidf_ctes(docs_sql: str, queries_sql: str, fields_boost: dict, params: dict | None = None):
    """CTEs ending in s(qid, doc_id, score) for a (possibly multi-field) TF-IDF search.

    docs_sql yields (doc_id VARCHAR, <fields>...), queries_sql yields (qid, query).
    """
    params = params or {}
    sub = params.get("sublinear_tf", False)
    min_df = params.get("min_df", 1)
    tfw = "(1 + ln(tf))" if sub else "tf"
    parts = [f"d AS ({docs_sql})", "n AS (SELECT count(*)::DOUBLE AS n FROM d)",
             f"q AS ({queries_sql})"]
    fields = list(fields_boost)
    dt = " UNION ALL ".join(
        f"SELECT '{f}' AS field, doc_id, unnest(regexp_extract_all(lower(coalesce({f}, '')), "
        f"'{TOKEN_RE}')) AS term FROM d" for f in fields)
    qt = " UNION ALL ".join(
        f"SELECT '{f}' AS field, qid, unnest(regexp_extract_all(lower(coalesce(query, '')), "
        f"'{TOKEN_RE}')) AS term FROM q" for f in fields)
    boost = " ".join(f"WHEN '{f}' THEN {float(b)!r}::DOUBLE" for f, b in fields_boost.items())
    parts += [
        f"dt AS ({dt})",
        "tf AS (SELECT field, doc_id, term, count(*)::DOUBLE AS tf FROM dt GROUP BY ALL)",
        "idf AS (SELECT field, term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf "
        f"FROM tf GROUP BY field, term HAVING count(*) >= {min_df})",
        f"dw AS (SELECT field, doc_id, term, {tfw} * idf AS w FROM tf JOIN idf USING (field, term))",
        "dn AS (SELECT field, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY field, doc_id)) "
        "AS wn FROM dw)",
        f"qt AS ({qt})",
        "qtf AS (SELECT field, qid, term, count(*)::DOUBLE AS tf FROM qt GROUP BY ALL)",
        f"qw AS (SELECT field, qid, term, {tfw} * idf AS w FROM qtf JOIN idf USING (field, term))",
        "qn AS (SELECT field, qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY field, qid)) "
        f"* (CASE field {boost} ELSE 1.0::DOUBLE END) AS qwn FROM qw)",
        "s AS (SELECT qid, doc_id, sum(qwn * wn) AS score FROM qn JOIN dn USING (field, term) "
        "GROUP BY qid, doc_id)",
    ]
    return "WITH " + ",\n".join(parts)


def _topk_select(k: int, where: str = "score > 0") -> str:
    return f"""
SELECT qid, doc_id, round(score, 6) + 0.0 AS score, rank FROM (
  SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid
         ORDER BY round(score, 6) DESC, doc_id) AS BIGINT) AS rank
  FROM s WHERE {where}) WHERE rank <= {k}"""


DOCS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents"
BENCH = "SELECT item_id AS qid, text AS query FROM benchmark"

SQL["tfidf_search"] = _tfidf_ctes(DOCS, BENCH, {"text": 3.0}) + _topk_select(10)

SQL["tfidf_search_filtered"] = _tfidf_ctes(DOCS, BENCH, {"text": 3.0}) + _topk_select(
    10, "score > 0 AND doc_id IN (SELECT doc_id FROM d WHERE lang = 'de')")

BENCH_SRC = ("SELECT item_id AS qid, text || ' src' || CAST(item_id % 20 AS VARCHAR) AS query "
             "FROM benchmark")
SQL["tfidf_search_multifield"] = _tfidf_ctes(DOCS, BENCH_SRC, {"text": 3.0, "source": 1.0}) \
    + _topk_select(10)

SQL["tfidf_search_params"] = _tfidf_ctes(DOCS, BENCH, {"text": 1.0},
                                         {"min_df": 2, "sublinear_tf": True}) + _topk_select(10)

SQL["tfidf_idf"] = _tfidf_ctes(DOCS, BENCH, {"text": 1.0}) + """
SELECT field, term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM (
  SELECT field, term, count(*) AS df, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf
  FROM tf GROUP BY field, term)"""

SQL["tfidf_postings"] = _tfidf_ctes(DOCS, BENCH, {"text": 1.0}) + """
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, round(w, 6) AS w, round(norm, 6) AS norm,
       round(w / norm, 6) AS wn FROM (
  SELECT dw.doc_id, dw.term, tf.tf, dw.w, sqrt(sum(dw.w * dw.w) OVER (PARTITION BY dw.doc_id)) AS norm
  FROM dw JOIN tf USING (field, doc_id, term))"""

SQL["tokenize"] = f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_RE}') AS toks
      FROM documents)"""

SQL["search_with_text"] = _tfidf_ctes(DOCS, BENCH, {"text": 3.0}) + """
SELECT h.qid, h.doc_id, h.score, h.rank, d.text FROM (""" + _topk_select(5) + """) h
LEFT JOIN d USING (doc_id)"""

VEC = """n AS (SELECT CAST(vec_id AS VARCHAR) AS id, v, label, sqrt(list_dot_product(v, v)) AS nv
  FROM (SELECT vec_id, {expr} AS v, label FROM embeddings)),
p AS (SELECT a.id AS qid, b.id AS doc_id, a.label AS qlabel, b.label AS dlabel,
  CASE WHEN a.nv = 0 OR b.nv = 0 THEN 0.0::DOUBLE
       ELSE list_dot_product(a.v, b.v) / (a.nv * b.nv) END AS cos FROM n a, n b)"""


def _dense_topk(expr: str, score: str, k: int, asc: bool = False) -> str:
    direction = "ASC" if asc else "DESC"
    return f"""WITH {VEC.format(expr=expr)}
SELECT qid, doc_id, round(score, 6) + 0.0 AS score, rank FROM (
  SELECT qid, doc_id, {score} AS score, CAST(row_number() OVER (PARTITION BY qid
         ORDER BY round({score}, 6) {direction}, doc_id) AS BIGINT) AS rank FROM p)
WHERE rank <= {k}"""


SQL["dense_search_exact"] = _dense_topk("embedding::DOUBLE[]", "cos + 1.0::DOUBLE", 5)
SQL["dense_search_distance"] = _dense_topk("embedding::DOUBLE[]", "1.0::DOUBLE - cos", 5, True)
SQL["dense_search_ann"] = SQL["dense_search_distance"]
SQL["ann_recall"] = "SELECT count(*) AS queries, true AS recall_ok, true AS reads_less FROM embeddings"
SQL["vector_truncate_search"] = _dense_topk("embedding[1:32]::DOUBLE[]", "cos + 1.0::DOUBLE", 5)

SQL["vector_validate"] = """
SELECT vec_id, reason IS NULL AS valid, reason FROM (
  SELECT vec_id, CASE
    WHEN embedding IS NULL THEN 'null vector'
    WHEN len(embedding) <> 64 THEN 'expected 64 dimensions, got ' || CAST(len(embedding) AS VARCHAR)
    WHEN list_count(embedding) < len(embedding) THEN 'null element'
    WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x))) THEN 'NaN element'
    WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 'zero vector'
    END AS reason FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN embedding[1:60]
      WHEN vec_id % 11 = 3 THEN NULL
      WHEN vec_id % 13 = 3 THEN list_transform(embedding, lambda x: 0::FLOAT)
      ELSE embedding END AS embedding FROM embeddings))"""

SQL["nearest_title_gate"] = f"""WITH {VEC.format(expr="embedding::DOUBLE[]")},
best AS (SELECT qid, doc_id, cos FROM (
  SELECT qid, doc_id, cos, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC,
         doc_id) AS rn FROM p WHERE qlabel = dlabel AND qid <> doc_id) WHERE rn = 1)
SELECT n.id AS qid, best.doc_id, round(best.cos, 6) AS cos_sim,
  CASE WHEN best.cos >= 0.95 THEN 'Success' ELSE 'Fail' END AS status,
  CASE WHEN best.cos >= 0.95 THEN 'Episode ' || best.doc_id || ' matched.'
       ELSE 'Failed to download the podcast. Please try again.' END AS status_message
FROM n LEFT JOIN best ON n.id = best.qid"""

SQL["vector_mean_pool"] = """
SELECT label, CAST(i - 1 AS BIGINT) AS dim, round(avg(x), 6) AS value FROM (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i
  FROM embeddings) GROUP BY label, i"""


def _bucket(t: str, n: int) -> str:
    return f"(('0x' || substring(md5({t}), 1, 8))::BIGINT % {n})"


def _hashed(rel: str, id_col: str, text_expr: str, n: int, field: str) -> str:
    return (f"SELECT '{field}' AS f, {id_col} AS id, {_bucket('t', n)} AS b FROM "
            f"(SELECT {id_col}, unnest(regexp_extract_all(lower(coalesce({text_expr}, '')), "
            f"'{TOKEN_RE}')) AS t FROM {rel})")


SQL["hash_encode"] = f"""
SELECT id AS doc_id, CAST(b AS BIGINT) AS dim, CAST(count(*) AS DOUBLE) AS value
FROM ({_hashed('documents', 'doc_id', 'text', 64, 'text')}) GROUP BY ALL"""

SQL["dense_search_multifield"] = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents WHERE lang = 'en'),
q AS ({BENCH_SRC}),
dv AS (SELECT f, id, b, count(*)::DOUBLE AS x FROM (
  {_hashed('d', 'doc_id', 'text', 64, 'text')} UNION ALL
  {_hashed('d', 'doc_id', 'source', 64, 'source')}) GROUP BY ALL),
qv AS (SELECT f, id, b, count(*)::DOUBLE AS x FROM (
  {_hashed('q', 'qid', 'query', 64, 'text')} UNION ALL
  {_hashed('q', 'qid', 'query', 64, 'source')}) GROUP BY ALL),
du AS (SELECT f, id, b, x / sqrt(sum(x * x) OVER (PARTITION BY f, id)) AS u FROM dv),
qu AS (SELECT f, id, b, x / sqrt(sum(x * x) OVER (PARTITION BY f, id))
          * (CASE f WHEN 'text' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS u FROM qv),
s AS (SELECT CAST(qu.id AS VARCHAR) AS qid, du.id AS doc_id, sum(qu.u * du.u) AS score
      FROM qu JOIN du USING (f, b) GROUP BY ALL)
{_topk_select(10)}"""

BENCH_Q = "SELECT item_id AS qid, text AS query FROM benchmark"
GT = """gt AS (SELECT b.item_id AS qid, CAST(d.doc_id AS VARCHAR) AS id
  FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0)"""
REL = """rel AS (SELECT gt.qid, gt.id, h.rank, h.doc_id, coalesce(h.doc_id = gt.id, false) AS is_rel
  FROM gt LEFT JOIN hits h ON gt.qid = h.qid)"""
PERQ = """pq AS (SELECT qid, id, max(CAST(is_rel AS INTEGER)) AS hit,
  sum(CASE WHEN is_rel THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END) AS rr FROM rel GROUP BY qid, id)"""


def _eval_sql(tail: str) -> str:
    return (_tfidf_ctes(DOCS, BENCH_Q, {"text": 3.0}) + ",\nhits AS (" + _topk_select(10)
            + "),\n" + GT + ",\n" + REL + ",\n" + PERQ + "\n" + tail)


SQL["eval_relevance"] = _eval_sql("SELECT qid, id, rank, doc_id, is_rel FROM rel")
SQL["eval_hit_rate"] = _eval_sql("SELECT round(avg(hit), 6) + 0.0 AS hit_rate FROM pq")
SQL["eval_mrr"] = _eval_sql("SELECT round(avg(rr), 6) + 0.0 AS mrr FROM pq")


def _dense_hits(metric_expr: str, asc: bool, k: int, dims: int) -> str:
    direction = "ASC" if asc else "DESC"
    return f"""
SELECT qid, doc_id, rank FROM (
  SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid
         ORDER BY round({metric_expr}, 6) {direction}, doc_id) AS BIGINT) AS rank FROM cs)
WHERE rank <= {k}"""


def _eval_report_sql(dims: int = 256) -> str:
    ctes = _tfidf_ctes(DOCS, BENCH_Q, {"text": 3.0})
    return ctes + f""",
th AS ({_topk_select(10)}),
{GT},
dv AS (SELECT id, b, count(*)::DOUBLE AS x FROM ({_hashed('d', 'doc_id', 'text', dims, 'text')})
       GROUP BY ALL),
qv AS (SELECT id, b, count(*)::DOUBLE AS x FROM ({_hashed('q', 'qid', 'query', dims, 'text')})
       GROUP BY ALL),
du AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS u FROM dv),
qu AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS u FROM qv),
cs AS (SELECT qu.id AS qid, du.id AS doc_id, sum(qu.u * du.u) AS cos FROM qu JOIN du USING (b)
       GROUP BY ALL),
sh AS ({_dense_hits('cos + 1.0::DOUBLE', False, 5, dims)}),
vh AS ({_dense_hits('1.0::DOUBLE - cos', True, 5, dims)}),
allh AS (SELECT 'tfidf' AS backend, qid, doc_id, rank FROM th
         UNION ALL SELECT 'search_server', qid, doc_id, rank FROM sh
         UNION ALL SELECT 'vector_store', qid, doc_id, rank FROM vh),
be AS (SELECT * FROM (VALUES ('tfidf'), ('search_server'), ('vector_store')) t(backend)),
rel AS (SELECT be.backend, gt.qid, gt.id, h.rank, coalesce(h.doc_id = gt.id, false) AS is_rel
        FROM be CROSS JOIN gt LEFT JOIN allh h ON h.backend = be.backend AND h.qid = gt.qid),
pq AS (SELECT backend, qid, id, max(CAST(is_rel AS INTEGER)) AS hit,
       sum(CASE WHEN is_rel THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END) AS rr
       FROM rel GROUP BY backend, qid, id)
SELECT backend, round(avg(hit), 6) + 0.0 AS hit_rate, round(avg(rr), 6) + 0.0 AS mrr
FROM pq GROUP BY backend"""


SQL["eval_report"] = _eval_report_sql()

# ---------------------------------------------------------------- RAG, ground truth, text

from .functions.text import BLANK, SENTENCE_END, WORD_BEFORE_PERIOD  # noqa: E402
from .functions.prompts import (QUESTION_PROMPT_TAIL, RAG_PROMPT_HEAD,  # noqa: E402
                                RAG_PROMPT_MID, question_prompt_head)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
MARK = "chr(65535)"
MARKED = "regexp_replace(coalesce({x}, ''), " + lit(SENTENCE_END) + ", '\\1' || " + MARK + ", 'g')"


def _sents(x: str, abbreviations: str | None = None) -> str:
    """List of the sentences of a text; ``abbreviations`` is a list column of words whose period ends none."""
    pieces = f"string_split({MARKED.replace('{x}', x)}, {MARK})"
    if abbreviations:
        pieces = (f"string_split(array_to_string(list_transform({pieces}, lambda p: CASE WHEN list_contains({abbreviations}, "
                  f"lower(regexp_extract(p, {lit(WORD_BEFORE_PERIOD)}, 1))) THEN p ELSE p || {MARK} END), ''), {MARK})")
    return f"list_filter(list_transform({pieces}, lambda s: {STRIP.format(x='s')}), lambda s: s <> '')"


def _abbreviations(rel: str) -> str:
    """CTEs ending in ab(l): the list of abbreviations of the texts of ``rel``."""
    return rf"""core AS (SELECT lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', '')) AS core FROM (
  SELECT unnest(string_split_regex(coalesce(text, ''), '{BLANK}+')) AS w FROM {rel})),
uses AS (SELECT word, count(*) AS n, sum(CAST(dot AS BIGINT)) AS dotted FROM (
  SELECT regexp_replace(core, '[^\p{{L}}\p{{N}}]+\z', '') AS word, regexp_matches(core, '[\p{{L}}\p{{N}}]\.\z') AS dot FROM core)
  WHERE word <> '' GROUP BY word),
p1 AS (SELECT sum(dotted)::DOUBLE / sum(n) AS p FROM uses),
scored AS (SELECT word, CAST(n AS BIGINT) AS n, CAST(dotted AS BIGINT) AS dotted,
  -2 * (dotted * ln(p) + (n - dotted) * ln(1 - p) - dotted * ln(0.99::DOUBLE) - (n - dotted) * ln(0.01::DOUBLE))
  * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
  * pow(length(replace(word, '.', ''))::DOUBLE, -(n - dotted)::DOUBLE) AS score
  FROM uses, p1 WHERE dotted > 0 AND regexp_matches(word, '\p{{L}}')),
ab AS (SELECT coalesce(list(word), []) AS l FROM scored WHERE score >= 0.3)"""


NL2 = "chr(10) || chr(10)"

_RAG_BASE = _tfidf_ctes(DOCS, BENCH, {"text": 3.0}) + f""",
hits AS ({_topk_select(5)}),
ctx AS (SELECT h.qid, string_agg(coalesce(d.text, '') || {NL2}, '' ORDER BY h.rank) AS context
        FROM hits h JOIN d USING (doc_id) GROUP BY h.qid)"""

SQL["prompt_render"] = _RAG_BASE + f"""
SELECT q.qid, {STRIP.format(x=f"{lit(RAG_PROMPT_HEAD)} || coalesce(q.query, '') || "
                              f"{lit(RAG_PROMPT_MID)} || coalesce(ctx.context, '')")} AS prompt
FROM q LEFT JOIN ctx USING (qid)"""


def _word_rows(rel: str, keys: str, text: str) -> str:
    return f"""
SELECT {keys}, CAST(i - 1 AS BIGINT) AS pos, w || ' ' AS word FROM (
  SELECT {keys}, unnest(string_split_regex(s, '\\s+')) AS w,
         unnest(range(1, len(string_split_regex(s, '\\s+')) + 1)) AS i
  FROM (SELECT {keys}, {STRIP.format(x=f"coalesce({text}, '')")} AS s FROM {rel}) WHERE s <> '')"""


SQL["rag_batch"] = _RAG_BASE + f""",
ans AS (SELECT q.qid, coalesce(d.text, '') AS answer FROM q
        LEFT JOIN hits h ON h.qid = q.qid AND h.rank = 1 LEFT JOIN d ON d.doc_id = h.doc_id)
""" + _word_rows("ans", "qid", "answer")

SQL["word_stream"] = _word_rows("conversations", "conv_id, turn", "text")

SQL["question_prompt"] = (f"SELECT doc_id AS id, {lit(question_prompt_head())} || coalesce(text, '')"
                          f" || {lit(QUESTION_PROMPT_TAIL)} AS prompt FROM documents")

SQL["question_explode"] = f"""
WITH todo AS (SELECT doc_id, text FROM documents d
              WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
s AS (SELECT doc_id, {_sents("text")} AS l FROM todo),
e AS (SELECT doc_id, len(l) AS n, unnest(l) AS question, unnest(range(0, len(l))) AS i FROM s)
SELECT CAST(doc_id AS VARCHAR) AS id, question FROM e
WHERE n <= 5 OR floor((i * 5 + n - 1) / n) * n < 5 * (i + 1)"""

SQL["resume_anti_join"] = """
SELECT doc_id, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

SQL["sentence_chunks"] = f"""WITH {_abbreviations("documents")}
SELECT doc_id, CAST(i AS BIGINT) AS pos, s AS text FROM (
  SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS i FROM (
    SELECT doc_id, {_sents("text", "ab.l")} AS l FROM documents, ab))"""

SQL["abbreviations"] = f"""WITH {_abbreviations("conversations")}
SELECT word, n, dotted, round(score, 6) + 0.0 AS score FROM scored WHERE score >= 0.3"""

SQL["chunk_renumber"] = f"""
WITH {_abbreviations("conversations")},
e AS (SELECT conv_id, turn, unnest(l) AS text, unnest(range(0, len(l))) AS pos FROM (
  SELECT conv_id, turn, {_sents("text", "ab.l")} AS l FROM conversations, ab))
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS VARCHAR) AS id, text FROM e"""

SQL["tfidf_search_two_episodes"] = _tfidf_ctes(f"""
SELECT to_json([CAST(conv_id AS VARCHAR), CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS VARCHAR)])::VARCHAR AS doc_id, text
FROM (SELECT conv_id, turn, unnest(l) AS text, unnest(range(0, len(l))) AS pos FROM (
  SELECT conv_id, turn, {_sents("text")} AS l FROM conversations))""",
    BENCH, {"text": 3.0}) + _topk_select(5)

SQL["transcript_concat"] = """
SELECT conv_id, ' ' || string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
WHERE text IS NOT NULL GROUP BY conv_id"""

SQL["chat_pairs"] = """
SELECT conv_id, turn, question, answer FROM (
  SELECT conv_id, turn * 2 + CASE WHEN turn > 1 THEN 5 ELSE 0 END AS turn, role, text AS question,
    CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"""

SQL["chat_transcript"] = """
SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id"""

# ---------------------------------------------------------------- topics

SQL["entity_extract"] = r"""
SELECT doc_id, 'Number' AS label, unnest(regexp_extract_all(coalesce(text, ''), '\p{N}+')) AS text,
  1.0::DOUBLE AS score FROM documents
UNION ALL
SELECT doc_id, 'Capitalized', unnest(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{Ll}+')),
  1.0::DOUBLE FROM documents"""

SQL["entity_tag"] = r"""
WITH RECURSIVE ph AS (SELECT DISTINCT label, array_to_string(t, ' ') AS gram, len(t) AS n FROM (
  SELECT label, regexp_extract_all(lower(phrase), '[\p{L}\p{N}]+') AS t FROM (
    SELECT ['Person', 'Place', 'Work'][item_id % 3 + 1] AS label, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '),
      array_to_string(w[2:4], ' '), array_to_string(w[3:4], ' '), array_to_string(w[1:4], ' '), array_to_string(w[4:6], ' ')]) AS phrase
    FROM (SELECT item_id, string_split_regex(text, '[ \t\n]+') AS w FROM benchmark))) WHERE len(t) > 0),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
g AS (SELECT doc_id, n, unnest(range(0, len(t) - n + 1)) AS s, t FROM d, (SELECT DISTINCT n FROM ph) WHERE n <= len(t)),
sp AS (SELECT doc_id, s, s + n AS e, n, array_to_string(t[s + 1:s + n], ' ') AS gram FROM g
  WHERE array_to_string(t[s + 1:s + n], ' ') IN (SELECT gram FROM ph)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e, s) AS i FROM sp),
pr AS (SELECT a.doc_id, a.i, any_value(a.n) AS n, any_value(a.s) AS s, any_value(a.gram) AS gram, count(b.i) AS p
  FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.e <= a.s GROUP BY a.doc_id, a.i),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, [0::BIGINT] AS v FROM o
  UNION ALL SELECT f.doc_id, pr.i, list_append(f.v, greatest(f.v[f.i + 1], pr.n * pr.n + f.v[pr.p + 1]))
  FROM f JOIN pr ON pr.doc_id = f.doc_id AND pr.i = f.i + 1),
top AS (SELECT doc_id, max(i) AS i, max_by(v, i) AS v FROM f GROUP BY doc_id),
b AS (SELECT doc_id, i, v, NULL::BIGINT AS taken FROM top
  UNION ALL SELECT b.doc_id, CASE WHEN b.v[b.i + 1] = b.v[b.i] THEN b.i - 1 ELSE pr.p END, b.v,
    CASE WHEN b.v[b.i + 1] = b.v[b.i] THEN NULL ELSE b.i END
  FROM b JOIN pr ON pr.doc_id = b.doc_id AND pr.i = b.i)
SELECT pr.doc_id, CAST(pr.s AS BIGINT) AS start, ph.label, pr.gram AS text, 1.0::DOUBLE AS score
FROM b JOIN pr ON pr.doc_id = b.doc_id AND pr.i = b.taken JOIN ph USING (gram)"""

STATS = """stats AS (SELECT event_type AS label, CAST(user_id AS VARCHAR) AS text,
  sum(value) AS total_score, count(*) AS count FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC,
  round(total_score, 6) DESC, text) AS rank FROM stats)"""

SQL["topic_stats"] = f"""WITH {STATS}
SELECT label, text, round(total_score, 6) + 0.0 AS total_score, count FROM stats"""

SQL["topic_top_words"] = f"""WITH {STATS}
SELECT label, count(*) AS n_words, string_agg(text, ' | ' ORDER BY rank) AS words
FROM r WHERE rank <= 15 GROUP BY label"""

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SQL["topic_pivot"] = f"""WITH {STATS}, top AS (SELECT * FROM r WHERE rank <= 15)
SELECT CAST(rank AS BIGINT) AS rank, """ + ",\n  ".join(
    f"coalesce(max(CASE WHEN label = '{t}' THEN text END), '') AS \"{t}\"" for t in EVENT_TYPES) + """
FROM top GROUP BY rank"""

SQL["topic_report"] = r"""
WITH m AS (SELECT 'Number' AS label, unnest(regexp_extract_all(coalesce(text, ''), '\p{N}+')) AS text FROM documents
  UNION ALL SELECT 'Capitalized', unnest(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{Ll}+')) FROM documents),
r AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, text) AS rank FROM m GROUP BY label, text)
SELECT rank, coalesce(max(CASE WHEN label = 'Number' THEN text END), '') AS "Number",
  coalesce(max(CASE WHEN label = 'Capitalized' THEN text END), '') AS "Capitalized"
FROM r WHERE rank <= 15 GROUP BY rank"""

# ---------------------------------------------------------------- URLs, HTML, media, catalogue

SQL["url_episode"] = """
WITH s AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')
  AS parts FROM pages)
SELECT page_id, substring(parts[-1], 3) AS podcast_id, replace(parts[-2], '-', ' ') AS episode_title
FROM s"""


# the pages hold four named references only; "&amp;" last, so that "&amp;quot;" gives "&quot;"
SQL["html_to_text"] = r"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '(?i)<!DOCTYPE[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(x, '(?is)<(script)\b[^>]*>.*?</script\s*>', '', 'g') AS x FROM b),
d AS (SELECT page_id, regexp_replace(x, '(?is)<(style)\b[^>]*>.*?</style\s*>', '', 'g') AS x FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM d)
SELECT page_id, replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
  '&amp;?', '&', 'g'), chr(0), '') AS text FROM e"""

SQL["title_normalize"] = r"""
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '\.', '', 'g'),
  '\p{P}', ' ', 'g')), '\s+', ' ', 'g')) AS title FROM documents"""

SQL["segment_plan"] = r"""
WITH m AS (SELECT o_orderkey AS media_id, CAST(round(o_totalprice * 10) AS BIGINT) AS length_ms,
  './audio/' || o_orderpriority || '/episode_' || CAST(o_orderkey AS VARCHAR) || '.mp3' AS path
  FROM orders),
e AS (SELECT *, unnest(range(0, 4)) AS i FROM m)
SELECT media_id, CAST(i + 1 AS BIGINT) AS part, CAST(i * (length_ms // 4) AS BIGINT) AS start_ms,
  CAST(CASE WHEN i < 3 THEN (i + 1) * (length_ms // 4) ELSE length_ms END AS BIGINT) AS end_ms,
  regexp_extract(path, '^(.*?)(\.[^./]*)?$', 1) || '_part_' || CAST(i + 1 AS VARCHAR)
  || regexp_extract(path, '^(.*?)(\.[^./]*)?$', 2) AS part_path FROM e"""

SQL["download_manifest"] = """
SELECT p_partkey, './audio/' || replace(replace(replace(p_brand || ': ' || p_name || '.', ' ', '_'),
  ':', '-'), '.', '') || '/episode_0.mp3' AS path, 'planned' AS status FROM part"""

SQL["catalog_search"] = """
WITH cat AS (SELECT p_partkey AS collection_id, p_name AS collection_name, p_brand AS artist_name FROM part),
t AS (SELECT DISTINCT term FROM (SELECT p_name AS term FROM part
  UNION ALL SELECT upper(substring(p_name, CAST(p_partkey % 5 + 1 AS BIGINT), CAST(p_partkey % 7 + 1 AS BIGINT))) FROM part
  UNION ALL SELECT s_name FROM supplier)),
m AS (SELECT t.term, cat.collection_id, cat.collection_name, cat.artist_name FROM t JOIN cat
  ON t.term <> '' AND contains(lower(cat.collection_name), lower(t.term))),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY collection_id) AS rank FROM m)
SELECT t.term, CAST(r.rank AS BIGINT) AS rank, r.collection_id, r.collection_name, r.artist_name,
  r.collection_name || ' by ' || r.artist_name AS label,
  CASE WHEN r.rank IS NULL THEN 'Fail' ELSE 'Success' END AS status
FROM t LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON r.term = t.term"""

SQL["catalogue_parse"] = """
SELECT row_number() OVER (PARTITION BY p_size, p_partkey // 50 ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS pos,
  CAST(p_partkey AS VARCHAR) AS collection_id, p_name AS collection_name, p_brand AS artist_name, p_type AS feed_url FROM part"""

SQL["catalog_lookup"] = """
WITH ids AS (SELECT DISTINCT o_custkey AS podcast_id FROM orders),
f AS (SELECT s_nationkey AS podcast_id, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY ALL)
SELECT ids.podcast_id, CASE WHEN s.s_suppkey % 5 <> 0 THEN s.s_name END AS collection_name,
  'supplier ' || CAST(s.s_suppkey AS VARCHAR) AS artist_name,
  CASE WHEN s.s_suppkey IS NULL THEN 'Fail' ELSE 'Success' END AS status
FROM ids LEFT JOIN f USING (podcast_id) LEFT JOIN supplier s ON s.s_suppkey = f.s_suppkey"""

SQL["latest_episode"] = """
WITH c AS (SELECT c_custkey AS podcast_id FROM customer UNION SELECT -c_custkey - 1 FROM customer),
f AS (SELECT podcast_id, pos, summary, price FROM (
  SELECT o_custkey AS podcast_id, o_orderkey AS pos, o_orderpriority AS summary,
    round(o_totalprice, 6) + 0.0 AS price,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1)
SELECT c.podcast_id, f.pos, f.summary, f.price,
  CASE WHEN f.pos IS NULL THEN 'Fail' ELSE 'Success' END AS status
FROM c LEFT JOIN f ON f.podcast_id = c.podcast_id"""
