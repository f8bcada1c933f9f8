"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from lodestone.plans.queries import LARGE, NOTHING, TAG, TWICE, WORDS
from lodestone.schema import DEFAULT_SIZE

#: The analyzer's boundaries in RE2's dialect.
WORD = r"(?:\p{L}[\p{L}\p{M}]*(?:[:.''’·]\p{L}[\p{L}\p{M}]*)*|\p{N}[\p{N}\p{M}]*(?:[.,;''’]\p{N}[\p{N}\p{M}]*)*|_+)+"


def words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(regexp_replace(lower({text}), '([\p{{Han}}\p{{Hiragana}}])', ' \1 ', 'g'), '([\p{{Katakana}}ー]+)', ' \1 ', 'g'), '{WORD}')"


DOCS = "docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, CASE WHEN lang = source THEN [lang] ELSE [lang, source] END AS tags FROM documents)"
TERMS = f"""{DOCS}, ft AS (
    SELECT *, CAST(len(terms) AS BIGINT) AS dl FROM (
        SELECT doc_id, 'title' AS field, {words("title")} AS terms FROM docs
        UNION ALL SELECT doc_id, 'content', {words("content")} FROM docs
        UNION ALL SELECT doc_id, 'tags', tags FROM docs
    ) WHERE len(terms) > 0
)"""
STATS = "stats AS (SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS sum_dl, sum(dl)::DOUBLE / count(*) AS avgdl FROM ft GROUP BY field)"
POSTINGS = f"""{TERMS}, post AS (SELECT field, term, doc_id, dl, count(*) AS tf FROM (SELECT field, doc_id, dl, unnest(terms) AS term FROM ft) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL), {STATS}"""
LOG = "log AS (SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op, props AS source FROM events)"
BODIES = """bodies AS (SELECT doc_id, lang, source AS src, n_chars, '{"title": "' || source || '", "tags": [["' || lang || '", ["' || source || '", [' || n_chars || ', null]]], true, ' || n_chars
    || '.5], "meta": {"n": ' || n_chars || ', "day": "2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0')
    || '", "deep": {"list": [1, "x", [2.0, "2024-01-02T03:04:05Z"], {"ok": false}], "none": null}}}' AS source FROM documents),
nodes AS (SELECT doc_id, t.id, t.fullkey, t.type AS t, t.atom, regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '', 'g') AS field FROM bodies, json_tree(bodies.source) t)"""
SETTLED = f"""{LOG}, seen AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY doc_id ORDER BY seq) = 'index', false) AS present FROM log),
settled AS (SELECT *, CAST(sum(CASE WHEN op = 'index' OR present THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM seen)"""


def scored(q: str) -> str:
    """(doc_id, title_score, content_score, tags_score, _score)."""
    q = q.replace("'", "''")
    return f"""WITH {POSTINGS}, qw AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({words(f"'{q}'")}) AS term) GROUP BY term),
    q AS (
        SELECT 'title' AS field, 2.0::DOUBLE AS boost, term, qtf FROM qw
        UNION ALL SELECT 'content', 1.0::DOUBLE, term, qtf FROM qw
        UNION ALL SELECT 'tags', 1.0::DOUBLE, '{q}', 1
    ), hits AS (
        SELECT doc_id, field, qtf * boost * 2.2::DOUBLE * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
            * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * (CASE WHEN field = 'tags' THEN 1 ELSE dl END) / avgdl))) AS s
        FROM post JOIN q USING (field, term) JOIN df USING (field, term) JOIN stats USING (field)
    ), sums AS (SELECT doc_id, field, round(sum(s), 6) AS s FROM hits GROUP BY ALL),
    scored AS (
        SELECT doc_id, max(s) FILTER (field = 'title') AS title_score, max(s) FILTER (field = 'content') AS content_score, max(s) FILTER (field = 'tags') AS tags_score, max(s) AS _score
        FROM sums GROUP BY doc_id
    )"""


def ranked(q: str) -> str:
    return f"{scored(q)}, best AS (SELECT row_number() OVER (ORDER BY _score DESC, doc_id) AS rank, doc_id, _score FROM scored)"


def oracle_sql() -> dict[str, str]:
    topk = f"{ranked(WORDS)} SELECT rank, doc_id, _score, title, content, array_to_string(tags, ' ') AS tags FROM best JOIN docs USING (doc_id) WHERE rank <= {DEFAULT_SIZE}"
    size_k = f"{ranked(WORDS)} SELECT rank, doc_id, _score FROM best WHERE rank <= {LARGE}"
    best, twice = f"{scored(WORDS)} SELECT * FROM scored", f"{scored(TWICE)} SELECT doc_id, _score FROM scored"
    joined = "SELECT doc_id, title, content, array_to_string(tags, ' ') AS tags FROM docs"
    return {
        "get_document": f"WITH {DOCS} {joined} WHERE doc_id = 42",
        "get_missing": f"WITH {DOCS} {joined} WHERE doc_id = -1",
        "upsert_snapshot": f"WITH {LOG} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op = 'index'",
        "upsert_ack": f"WITH {SETTLED} SELECT doc_id, seq, version, CASE WHEN present THEN 'updated' ELSE 'created' END AS result FROM settled WHERE op = 'index'",
        "delete_snapshot": f"WITH {DOCS} SELECT doc_id, title, array_to_string(tags, ' ') AS tags FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "delete_ack": f"WITH {SETTLED} SELECT doc_id AS deleted, seq FROM settled WHERE op = 'delete' AND present",
        "delete_missing": f"WITH {SETTLED} SELECT doc_id, seq FROM settled WHERE op = 'delete' AND NOT present",
        "json_body_fields": f"WITH {LOG} SELECT doc_id, seq, coalesce(json_extract_string(source, '$.k'), '') AS k, CAST(CASE WHEN json_extract_string(source, '$.k') IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_values FROM log",
        "dynamic_fields": f"""WITH {LOG}, kv AS (SELECT k AS field, json_type(source, '$.' || k) AS t FROM (SELECT source, unnest(json_keys(source)) AS k FROM log))
            SELECT field, CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'long' WHEN t = 'DOUBLE' THEN 'float' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'OBJECT' THEN 'object' ELSE 'text' END AS type, count(*) AS n
            FROM kv WHERE t <> 'NULL' GROUP BY ALL""",
        "tokenize_standard": f"SELECT doc_id, array_to_string({words('text')}, ' ') AS terms FROM documents",
        "tokenize_pages": f"SELECT page_id, array_to_string({words('html')}, ' ') AS terms FROM pages",
        "json_body_nested": f"""WITH {BODIES}, tags AS (
                SELECT doc_id, string_agg(atom ->> '$', ' ' ORDER BY id) AS tags, count(*) AS n FROM nodes WHERE field = 'tags' AND t NOT IN ('ARRAY', 'OBJECT', 'NULL') GROUP BY doc_id
            ), objects AS (
                SELECT doc_id, bool_or(field = 'meta' AND t = 'OBJECT') AS meta, bool_or(field = 'tags' AND t = 'OBJECT') AS tags FROM nodes GROUP BY doc_id
            ) SELECT doc_id, atom ->> '$' AS title, tags.tags, n AS n_tags, CAST(0 AS BIGINT) AS n_content, objects.meta AS meta_is_rejected, objects.tags AS tags_are_rejected
            FROM nodes JOIN tags USING (doc_id) JOIN objects USING (doc_id) WHERE field = 'title'""",
        "dynamic_fields_nested": f"""WITH {BODIES} SELECT field, CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'long' WHEN t = 'DOUBLE' THEN 'float' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'OBJECT' THEN 'object'
                WHEN regexp_matches(atom ->> '$', '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9:]+Z?)?$') THEN 'date' ELSE 'text' END AS type, count(*) AS n
            FROM nodes WHERE fullkey <> '$' AND t NOT IN ('ARRAY', 'NULL') GROUP BY ALL""",
        "json_lines_read": "SELECT 'd' || doc_id AS doc_id, lang || ' ' || source AS tags FROM documents",
        "ingest_snapshot": f"WITH {LOG} SELECT CAST(doc_id AS VARCHAR) AS doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op = 'index'",
        "compacted_log": f"WITH {SETTLED} SELECT doc_id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(source, seq) AS source, max(version) AS version FROM settled GROUP BY doc_id",
        "multivalue_flatten": f"""SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_values, array_to_string(terms, ' ') AS terms, CAST(len(terms) AS BIGINT) AS dl FROM (
                SELECT doc_id, lines, flatten(list_transform(lines, lambda v: {words('v')})) AS terms FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
            ) WHERE len(terms) > 0""",
        "keyword_terms": "SELECT doc_id, CASE WHEN lang = source THEN lang ELSE concat_ws(' ', lang, source) END AS terms, CAST(CASE WHEN lang = source THEN 1 ELSE 2 END AS BIGINT) AS dl FROM documents",
        "field_length": f"WITH {TERMS} SELECT doc_id, field, dl FROM ft",
        "term_frequency": f"WITH {POSTINGS} SELECT field, term, doc_id, tf FROM post",
        "document_frequency": f"WITH {POSTINGS} SELECT field, term, df FROM df",
        "collection_stats": f"WITH {TERMS}, {STATS} SELECT field, n_docs, sum_dl, round(avgdl, 6) AS avgdl FROM stats",
        "idf": f"WITH {POSTINGS} SELECT field, term, df, round(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df JOIN stats USING (field)",
        "bm25_single_field": f"{scored(WORDS)} SELECT doc_id, content_score FROM scored WHERE content_score IS NOT NULL",
        "boosted_title": f"{scored(WORDS)} SELECT doc_id, title_score FROM scored WHERE title_score IS NOT NULL",
        "keyword_match": f"{scored(TAG)} SELECT doc_id, tags_score FROM scored WHERE tags_score IS NOT NULL",
        "match_or": f"{scored(WORDS)} SELECT doc_id FROM scored",
        "duplicate_terms": twice,
        "zero_term_query": f"{scored(NOTHING)} SELECT doc_id, _score FROM scored",
        "best_fields": best,
        "search_topk": topk,
        "search_size_k": size_k,
        "search_index_topk": topk,
        "search_index_size_k": size_k,
        "best_fields_index": best,
        "duplicate_terms_index": twice,
        "search_after_writes": topk,
        "best_fields_after_writes": best,
    }
