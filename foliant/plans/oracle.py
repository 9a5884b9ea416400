"""DuckDB twins of the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _plain(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', '', 'gs')"
    for a, b in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return _strip(out)


_BODY = "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gsi'), '<script[^>]*>.*?</script>', ' ', 'gsi'), '<style[^>]*>.*?</style>', ' ', 'gsi')"
_END = r"^(.*?)(?:</p>|</?(?:div|h[1-6]|ul|ol|li|table|section|article|main|nav|header|footer|blockquote|body|html)(?:\s[^>]*)?>|$)"
_H = [rf"<h{k}(?:\s[^>]*)?>(.*?)</h{k}>" for k in range(1, 7)]
_TITLE = "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}', 'si') THEN {_plain(f"regexp_extract(body, '{p}', 1, 'si')")}" for p in _H) + " END"
_CHAPTERS = f"""
ch AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS doc_name, page_id AS item_no, html FROM pages),
ct AS (
  SELECT doc_name, item_no, title,
         '≦' || title || '≧' || chr(10) || chr(10) || array_to_string(list_transform(
           string_split_regex(body, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda x: {_plain(f"regexp_extract(x, '{_END}', 1, 'si')")} || chr(10)), '') AS text
  FROM (SELECT *, {_TITLE} AS title FROM (SELECT *, {_BODY} AS body FROM ch)) WHERE title <> ''
),
books AS (SELECT doc_name, string_agg(text, '' ORDER BY item_no) AS text FROM ct GROUP BY doc_name)
"""
_MARK = f"≦{_SPACE}*[^≧]+{_SPACE}*≧"
_LABEL = f"≦{_SPACE}*([^≧]+?){_SPACE}*≧"
_PAGES = f"""
cut AS (SELECT doc_name, string_split_regex(text, '{_MARK}') AS parts, list_concat([NULL], regexp_extract_all(text, '{_LABEL}', 1)) AS labels FROM books),
pg AS (
  SELECT doc_name, unnest(range(len(parts))) AS page_ord, unnest(parts) AS part, unnest(labels) AS label, len(labels) > 1 AS marked FROM cut
),
pages_out AS (
  SELECT doc_name, CAST(page_ord AS INTEGER) AS page_ord, TRY_CAST(page_label AS INTEGER) AS page_number, page_label, text FROM (
    SELECT doc_name, page_ord, {_strip("part")} AS text,
           CASE WHEN page_ord = 0 THEN CASE WHEN marked THEN '0' ELSE '1' END
                WHEN {_strip("label")} = '' THEN '未命名页面' ELSE {_strip("label")} END AS page_label
    FROM pg) WHERE text <> ''
)
"""
_NAME = "source || '-' || doc_id"
_CHUNKS = f"""
dc AS (
  SELECT doc_id, source AS doc_name, {_NAME} || '_p1_c1' AS chunk_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS INTEGER) END AS page_number, text,
         list_concat(string_split_regex(text, '[.!?\n]+'), [' ', lang]) AS keyword_summaries,
         list_concat(list_transform(string_split(text, chr(10)), lambda x: ' ' || x || '? '), [CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END]) AS generated_questions,
         CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 <> 0 END AS is_meaningful
  FROM documents
)
"""
_POSTINGS = f"""{_CHUNKS},
tok AS (SELECT chunk_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1) AS t FROM dc),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(t) AS term, len(t) AS dl FROM tok) GROUP BY chunk_id, term),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT (SELECT count(*) FROM dc) AS n, (SELECT sum(tf) FROM post)::DOUBLE / (SELECT count(*) FROM dc) AS avgdl),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM terms, corpus),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)
"""


def _bm25(queries: str, limit: int) -> str:
    return f"""
tq AS ({queries}),
qt AS (
  SELECT request_id, sub_id, term, count(*) AS qtf FROM (
    SELECT request_id, sub_id, unnest(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1)) AS term FROM tq)
  GROUP BY ALL
),
sc AS (
  SELECT request_id, sub_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term), corpus GROUP BY ALL
),
bm AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id, sub_id ORDER BY score DESC, chunk_id) AS INTEGER) AS bm25_rank FROM sc WHERE score > 0)
  WHERE bm25_rank <= {limit}
)
"""


_TEXT_Q = "SELECT item_id // 4 AS request_id, CAST(item_id % 4 AS INTEGER) AS sub_id, text AS query FROM benchmark"
_UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-9))"
_VECTORS = f"""
names AS (SELECT doc_id, {_NAME} || '_p1_c1' AS chunk_id FROM documents),
cv AS (SELECT chunk_id, {_UNIT} AS v FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN names ON vec_id = doc_id)),
qv AS (
  SELECT request_id, sub_id, {_UNIT} AS v FROM (
    SELECT vec_id // 100 AS request_id, CAST(vec_id % 100 // 50 AS INTEGER) AS sub_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0)
),
ov AS (
  SELECT vec_id AS question_id, chunk_id, 'question ' || vec_id AS question, {_UNIT} AS v FROM (
    SELECT vec_id, chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN names ON vec_id // 4 = doc_id)
)
"""


def _near(name: str, vectors: str, key: str, tie: str, k: int, queries: str = "qv") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, sub_id ORDER BY score DESC, {tie}) AS rank FROM (
      SELECT request_id, sub_id, x.* EXCLUDE (v), round(list_inner_product(q.v, x.v), 9) AS score FROM {queries} q, {vectors} x) WHERE score >= 0.15)
  WHERE rank <= {k}
)
"""


_DENSE = (
    _near("dn", "cv", "chunk_id", "chunk_id", 50)
    + """,
dense AS (
  SELECT *, 'dense_chunk_text' AS retrieval_type FROM (
    SELECT request_id, chunk_id, max(score) AS retrieval_score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY max(score) DESC, chunk_id) AS INTEGER) AS rank
    FROM dn GROUP BY request_id, chunk_id) WHERE rank <= 10
)
"""
)
_QUESTION = (
    _near("qn", "ov", "question_id", "CAST(question_id AS VARCHAR)", 50)
    + """,
asked AS (
  SELECT *, 'dense_question' AS retrieval_type FROM (
    SELECT request_id, chunk_id, question AS matched_question, score AS retrieval_score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY score DESC, question_id, sub_id) AS n FROM qn) WHERE n = 1) WHERE rank <= 10
)
"""
)
_HQ = f"hq AS (SELECT t.*, qv.v FROM ({_TEXT_Q}) t LEFT JOIN qv USING (request_id, sub_id))"
_FUSED = (
    _POSTINGS
    + ","
    + _VECTORS
    + ","
    + _HQ
    + ","
    + _bm25("SELECT request_id, sub_id, query FROM hq", 20)
    + ","
    + _near("hn", "cv", "chunk_id", "chunk_id", 20, "(SELECT request_id, sub_id, v FROM hq WHERE v IS NOT NULL)")
    + """,
both_legs AS (
  SELECT request_id, sub_id, chunk_id, bm25_rank, CAST(rank AS INTEGER) AS embedding_rank,
         round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + rank), 0), 9) AS original_rrf_score
  FROM bm FULL JOIN hn USING (request_id, sub_id, chunk_id)
),
fused AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY original_rrf_score DESC, sub_id) AS n FROM both_legs) WHERE n = 1
)
"""
)
_MINMAX = "CASE WHEN max({s}) OVER w = min({s}) OVER w THEN 1.0 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"
_HYBRID = (
    _FUSED
    + f""",
mm AS (SELECT *, {_MINMAX.format(s="original_rrf_score")} AS retrieval_score FROM fused WINDOW w AS (PARTITION BY request_id)),
hybrid AS (
  SELECT *, 'rrf_bm25_embedding_fusion' AS retrieval_type FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(retrieval_score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM mm) WHERE rank <= 10
)
"""
)
_MERGED = (
    _HYBRID
    + ","
    + _DENSE
    + ","
    + _QUESTION
    + """,
hits AS (
  SELECT request_id, 'text' AS path, 1 AS o, rank, chunk_id, round(retrieval_score, 6) AS retrieval_score, retrieval_type FROM dense
  UNION ALL SELECT request_id, 'keyword', 2, rank, chunk_id, round(retrieval_score, 6), retrieval_type FROM hybrid
  UNION ALL SELECT request_id, 'question', 3, rank, chunk_id, round(retrieval_score, 6), retrieval_type FROM asked
),
firsts AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o, rank, chunk_id) AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY o) AS n FROM hits) WHERE n = 1
),
merged AS (
  SELECT f.request_id, f.position, f.chunk_id, f.retrieval_score, f.retrieval_type, p.paths FROM firsts f JOIN (
    SELECT request_id, chunk_id, string_agg(path || '=' || printf('%.6f', retrieval_score), ';' ORDER BY o) AS paths FROM hits GROUP BY ALL) p USING (request_id, chunk_id)
),
good AS (SELECT DISTINCT chunk_id FROM labels JOIN names USING (doc_id) WHERE quality = 1),
useful AS (SELECT * FROM merged WHERE chunk_id IN (SELECT chunk_id FROM good))
"""
)
_WITH = "WITH "
_OK_REPAIR = "'{\"optimized_chunk_B_text\": \" fixed ' || doc_id || ' \"}'"
_ATTEMPTS = f"""
att AS (
  SELECT {_NAME} AS chunk_id, attempt,
         CASE WHEN doc_id % 9 = 0 THEN 'json_decode_error' WHEN (doc_id + attempt) % 8 IN (0, 1) THEN 'success' WHEN (doc_id + attempt) % 8 = 2 THEN 'missing_key'
              WHEN (doc_id + attempt) % 8 = 3 THEN 'empty_content' ELSE 'json_decode_error' END AS status,
         'fixed ' || doc_id AS fixed
  FROM documents, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS attempt)
),
res AS (
  SELECT chunk_id, attempt, status, CASE WHEN status = 'success' THEN fixed END AS refined_text FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN status = 'json_decode_error' THEN 1 ELSE 0 END, CASE WHEN status = 'json_decode_error' THEN -attempt ELSE attempt END) AS n
    FROM att WHERE attempt <= 5) WHERE n = 1
)
"""
_ANNOTATED = f"""
ann AS (
  SELECT doc_id, {_NAME} AS chunk_id, attempt, (doc_id + 2 * attempt) % 7 < 2 AS valid, doc_id % 6 <> 0 AS good, text
  FROM documents, (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS attempt)
),
fv AS (SELECT chunk_id, bool_or(valid AND attempt <= 3) AS done, any_value(good) AS good, any_value(doc_id) AS doc_id, any_value(text) AS text FROM ann GROUP BY chunk_id)
"""
_LAST4 = "last4 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 AND role IN ('user', 'assistant'))"

ORACLE_SQL: dict[str, str] = {
    "chapters_to_text": _WITH + _CHAPTERS + "SELECT doc_name, item_no, title, text FROM ct",
    "assemble_books": _WITH + _CHAPTERS + "SELECT * FROM books",
    "conversion_report": _WITH + _CHAPTERS + "SELECT DISTINCT doc_name, CASE WHEN doc_name IN (SELECT doc_name FROM ct) THEN 'converted' ELSE 'failed' END AS status FROM ch",
    "split_pages": _WITH + _CHAPTERS + "," + _PAGES + "SELECT * FROM pages_out",
    "chunk_ids": _WITH + _CHAPTERS + "," + _PAGES + r"SELECT doc_name, page_ord, doc_name || '_p' || translate(coalesce(CAST(page_number AS VARCHAR), page_label), ' /\', '___') || '_c1' AS chunk_id FROM pages_out",
    "chunk_counts": "SELECT source AS doc_name, count(*) AS n_chunks FROM documents GROUP BY ROLLUP (source)",
    "context_windows": _WITH + _CHUNKS + """
        SELECT * EXCLUDE (doc_id) FROM (
          SELECT doc_name, doc_id, page_number, chunk_id, text, lag(text) OVER w AS text_a, lead(text) OVER w AS text_c
          FROM dc WINDOW w AS (PARTITION BY doc_name ORDER BY page_number NULLS LAST, doc_id))
        WHERE text_a IS NOT NULL AND text_c IS NOT NULL""",
    "resolve_attempts": _WITH + _ATTEMPTS + "SELECT * FROM res",
    "refine_merge": _WITH + _ATTEMPTS + f"SELECT {_NAME} AS chunk_id, coalesce(refined_text, text) AS text FROM documents LEFT JOIN res ON chunk_id = {_NAME}",
    "annotation_parse": _WITH + _ANNOTATED + "SELECT chunk_id, attempt, valid, CASE WHEN valid THEN good END AS is_meaningful, CASE WHEN valid THEN 'k' || doc_id END AS keywords FROM ann",
    "annotate_chunks": _WITH + _ANNOTATED + f"SELECT chunk_id, CAST(length(text) AS INTEGER) AS n_text, 'k' || doc_id AS keywords, true AS is_meaningful FROM fv WHERE done AND good AND {_strip('text')} <> ''",
    "annotation_stats": _WITH + _ANNOTATED + f""", f AS (SELECT *, doc_id % 13 = 0 OR {_strip('text')} = '' AS blank FROM fv)
        SELECT count(*) AS calls, count(*) FILTER (blank OR done) AS success, count(*) FILTER (NOT blank AND done AND good) AS meaningful,
               count(*) FILTER ((blank OR done) AND NOT (NOT blank AND done AND good)) AS not_meaningful, count(*) FILTER (NOT blank AND NOT done) AS failed,
               round(count(*) FILTER (blank OR done) / count(*), 6) AS success_rate FROM f""",
    "meaningful_rule": f"""SELECT doc_id, length(t) >= 20 AND len(regexp_extract_all(t, '[\\p{{L}}]+')) >= 4
        AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / greatest(length(t), 1) >= 0.5 AS is_meaningful FROM (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents)""",
    "select_indexable": _WITH + _CHUNKS + f"""
        SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN chunk_id ELSE 'auto_id_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS chunk_id, doc_name,
               coalesce(page_number, -1) AS page_number, CAST(length({_strip('text')}) AS INTEGER) AS n_text, CAST(len(keyword_summaries) AS INTEGER) AS n_phrases
        FROM dc WHERE coalesce(is_meaningful, true) AND {_strip('text')} <> ''""",
    "l2_normalize": f"SELECT vec_id, CAST(unnest(range(len(u))) AS INTEGER) AS pos, round(unnest(u), 6) AS value FROM (SELECT vec_id, {_UNIT} AS u FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * 3.0) AS v FROM embeddings))",
    "postings": _WITH + _POSTINGS + "SELECT chunk_id, term, tf, dl FROM post",
    "bm25_stats": r"""WITH pairs AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS term FROM documents),
        raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM pairs WHERE length(term) > 1 GROUP BY term),
        mean AS MATERIALIZED (SELECT 0.25 * avg(r) AS low FROM raw)
        SELECT term, df, round(CASE WHEN r < 0 THEN low ELSE r END, 6) AS idf FROM raw CROSS JOIN mean""",
    "bm25_search": _WITH + _POSTINGS + "," + _bm25(_TEXT_Q, 10) + "SELECT request_id, sub_id, chunk_id, round(score, 6) AS score, bm25_rank FROM bm",
    "tfidf_keywords": _WITH + _POSTINGS + """
        SELECT chunk_id, term, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(weight, 9) DESC, term) AS rank FROM (
            SELECT chunk_id, term, tf * ln(n / df) AS weight FROM post JOIN terms USING (term), corpus)) WHERE rank <= 5""",
    "phrase_dictionary": _WITH + _CHUNKS + f"SELECT DISTINCT phrase FROM (SELECT {_strip('p')} AS phrase FROM (SELECT unnest(keyword_summaries) AS p FROM dc)) WHERE phrase <> ''",
    "phrase_index": _WITH + _CHUNKS + f""",
        ph AS (SELECT DISTINCT phrase FROM (SELECT {_strip('p')} AS phrase FROM (SELECT unnest(keyword_summaries) AS p FROM dc)) WHERE phrase <> ''),
        pt AS (SELECT phrase, list_filter(string_split_regex(phrase, '{_SPACE}+'), lambda t: t <> '') AS t FROM ph)
        SELECT phrase, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT phrase, unnest(t) AS term, len(t) AS dl FROM pt) GROUP BY phrase, term""",
    "question_index": _WITH + _CHUNKS + f", q AS (SELECT chunk_id, CAST(generate_subscripts(generated_questions, 1) - 1 AS INTEGER) AS pos, unnest(generated_questions) AS g FROM dc) SELECT chunk_id, pos, {_strip('g')} AS question FROM q WHERE {_strip('g')} <> ''",
    "check_index": _WITH + _CHUNKS + "," + _VECTORS + f""",
        q AS (SELECT chunk_id, generate_subscripts(generated_questions, 1) - 1 AS pos, {_strip('unnest(generated_questions)')} AS question FROM dc),
        qs AS (SELECT chunk_id, pos FROM q WHERE question <> '')
        SELECT 'chunk_without_id' AS check_name, count(*) AS n, 'warning' AS severity, min(chunk_id) AS example FROM dc WHERE chunk_id IS NULL
        UNION ALL SELECT 'duplicate_chunk_id', count(*), 'warning', min(chunk_id) FROM (SELECT chunk_id FROM dc GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'chunk_without_vector', count(*), 'error', min(chunk_id) FROM dc WHERE chunk_id NOT IN (SELECT chunk_id FROM cv)
        UNION ALL SELECT 'vector_without_chunk', count(*), 'error', min(chunk_id) FROM cv WHERE chunk_id NOT IN (SELECT chunk_id FROM dc)
        UNION ALL SELECT 'question_without_vector', count(*), 'error', min(chunk_id) FROM qs WHERE pos <> 0
        UNION ALL SELECT 'vector_without_question', 0, 'error', NULL
        UNION ALL SELECT 'question_without_chunk', count(*), 'warning', min(chunk_id) FROM qs WHERE chunk_id NOT IN (SELECT chunk_id FROM dc)""",
    "expand_queries": """
        WITH w AS (SELECT item_id, text, string_split(text, ' ') AS s FROM benchmark),
        r AS (SELECT item_id AS request_id, text AS question, CASE WHEN item_id % 3 = 0 THEN s[1:2] ELSE [] END AS broad, s[3:4] AS keyword FROM w),
        a AS (SELECT request_id, list_concat([question], broad) AS l, 'text' AS path FROM r UNION ALL SELECT request_id, list_concat(keyword, broad), 'keyword' FROM r)
        SELECT request_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sub_id, unnest(l) AS query, path FROM a""",
    "instruct_query": "SELECT item_id, 'Instruct: Find the passages that answer the question.' || chr(10) || 'Query:' || text AS query FROM benchmark",
    "dense_search": _WITH + _VECTORS + "," + _DENSE + "SELECT request_id, chunk_id, round(retrieval_score, 6) AS retrieval_score, rank, retrieval_type FROM dense",
    "question_search": _WITH + _VECTORS + "," + _QUESTION + "SELECT request_id, chunk_id, matched_question, round(retrieval_score, 6) AS retrieval_score, rank FROM asked",
    "rrf_fuse": _WITH + _FUSED + "SELECT request_id, sub_id, chunk_id, bm25_rank, embedding_rank, round(original_rrf_score, 6) AS original_rrf_score FROM fused",
    "minmax_scores": _WITH + _FUSED + f"SELECT request_id, chunk_id, round({_MINMAX.format(s='s')}, 4) AS retrieval_score FROM (SELECT *, round(original_rrf_score, 6) AS s FROM fused) WINDOW w AS (PARTITION BY request_id)",
    "hybrid_search": _WITH + _HYBRID + "SELECT request_id, chunk_id, bm25_rank, embedding_rank, 60 AS rrf_k, round(retrieval_score, 6) AS retrieval_score, rank, retrieval_type FROM hybrid",
    "merge_paths": _WITH + _MERGED + "SELECT * FROM merged",
    "filter_useful": _WITH + _MERGED + "SELECT * FROM useful",
    "assemble_context": _WITH + _MERGED + """
        SELECT request_id, string_agg('【相关片段 ' || n || ' (文档: ' || source || ', 作者: 未知, 页码: ' || CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE '未知' END || ', 块ID: ' || chunk_id || ')】' || chr(10) || text,
                 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context, string_agg(chunk_id, ',' ORDER BY n) AS chunk_ids
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position) AS n FROM useful) JOIN names USING (chunk_id) JOIN documents USING (doc_id) GROUP BY request_id""",
    "request_outcomes": _WITH + _MERGED + """
        SELECT request_id, coalesce(c, 0) AS n_candidates, coalesce(u, 0) AS n_useful,
               CASE WHEN c IS NULL THEN 'no_context_found' WHEN u IS NULL THEN 'no_context_found_after_usefulness' ELSE 'completed' END AS outcome
        FROM (SELECT DISTINCT item_id // 4 AS request_id FROM benchmark) LEFT JOIN (SELECT request_id, count(*) AS c FROM merged GROUP BY 1) USING (request_id)
        LEFT JOIN (SELECT request_id, count(*) AS u FROM useful GROUP BY 1) USING (request_id)""",
    "retrieval_stats": _WITH + _MERGED + """
        SELECT request_id, 'path_' || path AS stage, count(*) AS n FROM hits GROUP BY request_id, path
        UNION ALL SELECT request_id, 'unique', count(*) FROM merged GROUP BY request_id UNION ALL SELECT request_id, 'useful', count(*) FROM useful GROUP BY request_id""",
    "recent_history": f"WITH {_LAST4} SELECT * FROM last4",
    "format_history": f"""WITH {_LAST4}, b AS (SELECT conv_id, string_agg(chr(10) || role || ': ' || coalesce(text, ''), '' ORDER BY turn) AS body FROM last4 GROUP BY conv_id)
        SELECT conv_id, '[对话历史]' || coalesce(body, '') || chr(10) AS history FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id)""",
    "generator_messages": f"""WITH {_LAST4}, h AS (SELECT conv_id, list({{'role': role, 'content': coalesce(text, '')}} ORDER BY turn) AS l FROM last4 GROUP BY conv_id),
        m AS (SELECT conv_id, list_concat([{{'role': 'system', 'content': 'Answer from the fragments.'}}], l,
          [{{'role': 'user', 'content': 'question ' || conv_id}}, {{'role': 'tool', 'content': 'Fragments found:' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'context' ELSE '' END}},
           {{'role': 'assistant', 'content': 'Points to cover: a, ' || conv_id}}]) AS l FROM h)
        SELECT conv_id, CAST(pos AS INTEGER) AS pos, x.role AS role, x.content AS content FROM (SELECT conv_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM m)""",
    "judge_requests": "SELECT item_id, 'Fragment:' || chr(10) || text || chr(10) || 'Questions:' || chr(10) || 'first?' || chr(10) || 'q' || item_id AS request FROM benchmark",
    "rewrite_requests": f"""WITH {_LAST4}, b AS (SELECT conv_id, string_agg(chr(10) || role || ': ' || coalesce(text, ''), '' ORDER BY turn) AS body FROM last4 GROUP BY conv_id)
        SELECT conv_id, 'History: [对话历史]' || coalesce(body, '') || chr(10) || chr(10) || 'Now: and {{context}} ' || conv_id AS request FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id)""",
    "parse_rewrites": """SELECT item_id AS request_id, text AS question, CASE WHEN item_id % 4 = 0 THEN 'wider|' || item_id ELSE '' END AS broadened,
        CASE WHEN item_id % 4 = 0 THEN 'word' ELSE '' END AS keywords FROM benchmark WHERE item_id % 4 < 2""",
    "first_rows": "SELECT source AS doc_name, doc_id AS page_ord, 1 AS chunk_no, text FROM documents ORDER BY source, doc_id LIMIT 100",
    "build_requests": _WITH + _CHUNKS + """
        SELECT chunk_id, 'A: ' || coalesce(lag(text) OVER w, 'start') || chr(10) || 'B: ' || text || chr(10) || 'C: ' || coalesce(lead(text) OVER w, 'end') AS request
        FROM dc WINDOW w AS (PARTITION BY doc_name ORDER BY page_number NULLS LAST, doc_id)""",
    "apply_model": f"SELECT doc_id, CASE WHEN doc_id % 10 <> 0 AND {_strip('text')} <> '' THEN sha256(text) END AS response FROM documents",
    "embed_texts": """SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, CAST(unnest(l) AS DOUBLE) AS value
        FROM (SELECT doc_id, [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))] AS l FROM documents WHERE text IS NOT NULL)""",
    "lookup": _WITH + _VECTORS + "," + _DENSE + "SELECT request_id, chunk_id, rank, source AS doc_name, upper(source) AS text FROM dense JOIN names USING (chunk_id) JOIN documents USING (doc_id)",
    "preview": _WITH + _MERGED + """
        SELECT request_id, position, chunk_id, text, list_aggregate(list_transform(string_split(paths, ';'), lambda p: string_split(p, '=')[1]), 'string_agg', ';') AS paths
        FROM merged JOIN names USING (chunk_id) JOIN documents USING (doc_id)""",
    "chunk_files": _WITH + _CHUNKS + "SELECT doc_name, page_number, coalesce(CAST(page_number AS VARCHAR), doc_name) AS page_label, chunk_id, text FROM dc",
    "index_files": _WITH + _POSTINGS + "," + _VECTORS + f""",
        ph AS (SELECT DISTINCT phrase FROM (SELECT {_strip('p')} AS phrase FROM (SELECT unnest(keyword_summaries) AS p FROM dc)) WHERE phrase <> ''),
        q AS (SELECT {_strip('g')} AS question FROM (SELECT unnest(generated_questions) AS g FROM dc) WHERE {_strip('g')} <> '')
        SELECT *, 5 AS missing_before FROM (
          SELECT 'chunks' AS name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total FROM dc UNION ALL SELECT 'vectors', count(*), CAST(sum(len(v)) AS BIGINT) FROM cv
          UNION ALL SELECT 'postings', count(*), CAST(sum(tf) AS BIGINT) FROM post UNION ALL SELECT 'phrases', count(*), CAST(sum(length(phrase)) AS BIGINT) FROM ph
          UNION ALL SELECT 'questions', count(*), CAST(sum(length(question)) AS BIGINT) FROM q)""",
    "trial_build": _WITH + _CHUNKS + f""",
        f AS (SELECT * FROM dc WHERE coalesce(is_meaningful, true) AND {_strip('text')} <> '' ORDER BY doc_name, chunk_id LIMIT 50),
        t AS (SELECT chunk_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1))) FROM f)
        SELECT 'chunks' AS name, count(*) AS n FROM f UNION ALL SELECT 'vectors', count(*) FROM f UNION ALL SELECT 'postings', count(*) FROM t
        UNION ALL SELECT 'phrases', count(DISTINCT phrase) FROM (SELECT {_strip('p')} AS phrase FROM (SELECT unnest(keyword_summaries) AS p FROM f)) WHERE phrase <> ''
        UNION ALL SELECT 'questions', count(*) FROM (SELECT unnest(generated_questions) AS g FROM f) WHERE {_strip('g')} <> ''""",
    "learn_lexicon": """WITH runs AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS r FROM documents),
        c AS (SELECT word, count(*) AS n FROM (SELECT substr(r, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS word FROM runs, (VALUES (1), (2), (3)) t(k), generate_series(1, length(r)) g(i) WHERE i + k - 1 <= length(r)) GROUP BY word),
        big AS (SELECT * FROM c WHERE length(word) = 1 OR n >= 20), total AS (SELECT sum(n) AS t FROM c WHERE length(word) = 1),
        cuts AS (SELECT word, n, substr(word, 1, k) AS a, substr(word, k + 1) AS b FROM big, (VALUES (1), (2)) t(k) WHERE k < length(word))
        SELECT word, n FROM big WHERE length(word) = 1
        UNION ALL SELECT cuts.word, cuts.n FROM cuts JOIN big x ON x.word = a JOIN big y ON y.word = b CROSS JOIN total GROUP BY cuts.word, cuts.n
        HAVING round(min(ln(cuts.n * CAST(t AS DOUBLE) / (x.n * CAST(y.n AS DOUBLE)))), 9) >= 0.5""",
    "segment_words": """WITH RECURSIVE lex AS (
          SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) BETWEEN 2 AND 12 GROUP BY word HAVING count(*) >= 2),
        total AS (SELECT ln(sum(n)) AS t FROM lex),
        bits AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(text), '[^a-z.,;:!?\n]', '', 'g'), '[a-z]+') AS rs FROM benchmark),
        placed AS (SELECT item_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS run_no FROM bits),
        runs AS (SELECT DISTINCT r FROM placed),
        parts AS (SELECT r, CAST(i AS BIGINT) AS i, CAST(k AS BIGINT) AS k, substr(r, CAST(i AS BIGINT) + 1, CAST(k AS BIGINT)) AS w FROM runs, generate_series(0, length(r) - 1) g(i), generate_series(1, 12) h(k) WHERE i + k <= length(r)),
        edges AS (SELECT r, i, k, CASE WHEN k = 1 THEN t ELSE t - ln(n) END AS c FROM parts CROSS JOIN total LEFT JOIN lex ON word = w WHERE k = 1 OR n IS NOT NULL),
        best AS (
          SELECT r, CAST(length(r) AS BIGINT) AS i, [0.0::DOUBLE] AS cost, []::BIGINT[] AS step FROM runs
          UNION ALL
          SELECT r, i - 1, list_prepend(x.c, cost), list_prepend(x.k, step) FROM (
            SELECT b.r, b.i, b.cost, b.step, (SELECT struct_pack(c := min(e.c + b.cost[e.k]), k := arg_max(e.k, (-round(e.c + b.cost[e.k], 9), e.k))) FROM edges e WHERE e.r = b.r AND e.i = b.i - 1) AS x
            FROM best b WHERE b.i > 0)),
        walk AS (
          SELECT r, step, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS word_no FROM best WHERE i = 0
          UNION ALL SELECT r, step, p + step[p + 1], word_no + 1 FROM walk WHERE p < length(r)),
        words AS (SELECT r, word_no, substr(r, p + 1, step[p + 1]) AS word FROM walk WHERE p < length(r))
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY run_no, word_no) - 1 AS INTEGER) AS pos, word FROM placed JOIN words USING (r)""",
    "answer_store": f"""SELECT doc_id, CASE WHEN doc_id % 10 <> 0 AND {_strip('text')} <> '' THEN sha256(text) END AS response,
          (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 10 <> 0 AND {_strip('text')} <> '') AS n_sent,
          (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 10 <> 0 AND {_strip('text')} <> '' AND source < 'm') AS n_first FROM documents""",
    "phrase_labels": r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_ ]+')), ' +'), lambda w: w <> '') AS w FROM documents),
        g AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM s WHERE len(w) > 1), (VALUES (2), (3)) t(k) WHERE i + k - 1 <= len(w)),
        c AS (SELECT doc_id, phrase, k, count(*) AS tf FROM g GROUP BY ALL),
        f AS (SELECT phrase, k, sum(tf) AS f, count(*) AS df FROM c GROUP BY ALL HAVING sum(tf) >= 2),
        p AS (SELECT DISTINCT phrase AS whole, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k = 3)),
        h AS (SELECT phrase, sum(f) / count(*) AS nested FROM p GROUP BY phrase),
        v AS (SELECT f.phrase, log2(k + 1) * (f - coalesce(nested, 0)) / f * ln((SELECT count(*) FROM documents) / df) AS each FROM f LEFT JOIN h USING (phrase)),
        r AS (SELECT doc_id, phrase, tf * each AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * each, 9) DESC, phrase) AS rank FROM c JOIN v USING (phrase) WHERE round(tf * each, 9) > 0)
        SELECT doc_id AS chunk_id, phrase, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM r WHERE rank <= 5""",
    "running_heads": f"""WITH l AS (SELECT source AS doc_name, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')} <> '') AS l FROM documents),
        e AS (SELECT doc_name, p AS place, regexp_replace({_strip('l[p]')}, '[0-9]+', '#', 'g') AS line FROM l, (VALUES (1), (2), (-1), (-2)) t(p) WHERE l[p] IS NOT NULL)
        SELECT doc_name, place, line, count(*) AS n FROM e JOIN (SELECT source AS doc_name, count(*) AS pages FROM documents GROUP BY source) USING (doc_name)
        GROUP BY doc_name, place, line, pages HAVING count(*) >= 2 AND count(*) >= 0.001 * pages""",
    "text_corpus": "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE line <> '' GROUP BY line",
}
#: The same hits, however they are found.
ORACLE_SQL["block_search"] = ORACLE_SQL["bm25_search"]
ORACLE_SQL["pruned_search"] = ORACLE_SQL["dense_search"]
