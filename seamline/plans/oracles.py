"""The queries of plans.queries in SQL."""

from seamline.functions import STOP_WORDS

_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_PART = r"[\p{L}\p{N}_]{2,}"
_BLANK = r"[^\s\x0b\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = f"coalesce(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1), '')"

_CHUNKS = "ch AS (SELECT id AS chunk_id, min(content) AS content FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id)"
_ALL = f"al AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '{_PART}')) AS term FROM ch)"
_TERMS = f"tm AS (SELECT * FROM al WHERE term NOT IN {_STOP})"
_TF = "tf AS (SELECT chunk_id, term, count(*) AS tf FROM tm GROUP BY ALL)"
_IMPACT = """ln AS (SELECT chunk_id, sum(tf) AS chunk_len FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM ch) AS n, (SELECT sum(tf) FROM tf)::DOUBLE / (SELECT count(*) FROM ch) AS avgdl),
po AS (SELECT term, chunk_id, tf, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (1.5::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * chunk_len / avgdl) + tf) AS impact
 FROM tf JOIN ln USING (chunk_id) JOIN df USING (term), st)"""
_POST = ",\n".join([_CHUNKS, _ALL, _TERMS, _TF, _IMPACT])
_QUESTIONS = "qu AS (SELECT question_id, max(trim(question, ' ')) AS question, max(sources) AS sources FROM questions GROUP BY question_id)"
_HITS = """pl AS (SELECT id AS chunk_id, max(file_path) AS file_path, max(start_index) AS start_index, max(end_index) AS end_index, max(content) AS content FROM chunks GROUP BY id),
hi AS (SELECT * FROM (SELECT question_id, hit_rank AS rank, max(chunk_id) AS chunk_id, max(score) AS score FROM search_hits GROUP BY ALL) JOIN pl USING (chunk_id))"""


def _search(questions: str, k: int = 10) -> str:
    return f"""{_POST},
{questions},
qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '{_PART}')) AS term FROM qu) WHERE term NOT IN {_STOP} GROUP BY ALL),
sc AS (SELECT question_id, chunk_id, round(sum(qtf * impact), 6) AS score FROM qt JOIN po USING (term) GROUP BY ALL),
tk AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sc) WHERE rank < {k})"""


def _fixed(rows: list[tuple[str, str]]) -> str:
    return "qu AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") AS t(question_id, question))"


_NEW = "fl AS (SELECT path AS file_path, arg_max(content, (loaded_at, content)) AS content FROM source_files WHERE path IS NOT NULL GROUP BY path), nh AS (SELECT file_path, md5(content) AS content_md5 FROM fl)"
_OLD = """re AS (SELECT path AS file_path, max(content_md5) AS content_md5 FROM source_files GROUP BY path HAVING max(content_md5) IS NOT NULL),
oh AS (SELECT * FROM re UNION ALL SELECT path, md5(content) FROM upstream_files WHERE path NOT IN (SELECT file_path FROM re WHERE file_path IS NOT NULL))"""
_DIFF = f"""{_NEW}, {_OLD},
cp AS (SELECT nh.file_path FROM nh LEFT JOIN oh USING (file_path) WHERE oh.file_path IS NULL OR oh.content_md5 IS DISTINCT FROM nh.content_md5),
dp AS (SELECT DISTINCT file_path FROM oh WHERE file_path NOT IN (SELECT file_path FROM nh)),
ap AS (SELECT file_path FROM cp UNION SELECT file_path FROM dp)"""
_GOLD = "go AS (SELECT question_id, i - 1 AS gold_id, sources[i].file_path AS file_path, sources[i].first_character_index AS a, sources[i].last_character_index AS b FROM (SELECT question_id, sources, unnest(range(1, len(sources) + 1)) AS i FROM qu))"
_IOU = "CASE WHEN greatest(b, end_index) > least(a, start_index) AND (b - a) + (end_index - start_index) - greatest(0, least(b, end_index) - greatest(a, start_index)) <> 0 THEN greatest(0, least(b, end_index) - greatest(a, start_index))::DOUBLE / ((b - a) + (end_index - start_index) - greatest(0, least(b, end_index) - greatest(a, start_index))) ELSE 0.0 END"


def _recall(k: int) -> str:
    return f"""{_QUESTIONS}, {_HITS}, {_GOLD},
gh AS (SELECT question_id, gold_id, max(CASE WHEN hi.chunk_id IS NOT NULL AND ({_IOU}) >= 0.05::DOUBLE THEN 1 ELSE 0 END)::INT AS hit FROM go LEFT JOIN (SELECT * FROM hi WHERE rank < {k}) hi USING (question_id, file_path) GROUP BY ALL),
pq AS (SELECT question_id, count(gold_id) AS n_gold, coalesce(sum(hit), 0)::BIGINT AS n_found, CASE WHEN count(gold_id) > 0 THEN sum(hit)::DOUBLE / count(gold_id) ELSE 0.0 END AS recall FROM (SELECT question_id FROM qu) LEFT JOIN gh USING (question_id) GROUP BY ALL)"""


def _vectors(source: str, id_col: str) -> str:
    return f"""v AS (SELECT {id_col}::BIGINT AS chunk_id, any_value(embedding)::DOUBLE[] AS e FROM {source} WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY ALL)"""


def _knn(source: str, id_col: str) -> str:
    return f"""WITH {_vectors(source, id_col)},
s AS (SELECT q.chunk_id AS question_id, v.chunk_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.chunk_id % 50 = 0)
SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1 AS rank, chunk_id, score FROM s) WHERE rank < 10"""


_CACHE = f"""an AS (SELECT query, min(question_id) AS question_id FROM (SELECT question_id, trim(question, ' ') AS query FROM questions WHERE answer IS NOT NULL) GROUP BY query),
ca AS (SELECT query, rank, chunk_id, round(score, 6) AS score FROM hi JOIN an USING (question_id))"""

ORACLES: dict[str, str] = {
    "ext_filter": f"SELECT DISTINCT file_id, path, {_EXT} AS ext FROM source_files WHERE {_EXT} IN ('.py', '.md')",
    "blank_filter": f"SELECT DISTINCT file_id, path FROM source_files WHERE regexp_matches(content, '{_BLANK}')",
    "latest_files": f"WITH {_NEW} SELECT file_path, length(content)::INT AS n_chars FROM fl",
    "file_md5": f"WITH {_NEW} SELECT * FROM nh",
    "file_basename": f"SELECT DISTINCT path, {_NAME} AS name, lower({_EXT}) AS ext FROM source_files",
    "changed_files": f"WITH {_DIFF} SELECT file_path FROM cp",
    "deleted_files": f"WITH {_DIFF} SELECT file_path FROM dp",
    "affected_paths": f"WITH {_DIFF} SELECT file_path FROM ap",
    "kept_chunks": f"WITH {_DIFF} SELECT file_path, content_md5 AS row_md5 FROM oh WHERE file_path NOT IN (SELECT file_path FROM ap)",
    "removed_chunks": f"WITH {_DIFF} SELECT file_path, content_md5 AS row_md5 FROM oh WHERE file_path IN (SELECT file_path FROM ap)",
    "incremental_merge": f"WITH {_DIFF} SELECT file_path, content_md5 AS row_md5 FROM oh WHERE file_path NOT IN (SELECT file_path FROM ap) UNION ALL SELECT file_path, content_md5 FROM nh WHERE file_path IN (SELECT file_path FROM cp)",
    "assigned_ids": f"WITH {_DIFF} SELECT file_path, (SELECT max(id) FROM chunks) + row_number() OVER (ORDER BY file_path) AS chunk_id FROM cp",
    "tokenize_docs": f"SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '{_PART}')), 0) AS n_terms FROM documents",
    "token_counts": f"WITH {_CHUNKS}, {_ALL} SELECT term, count(*) AS n FROM al GROUP BY term",
    "stopword_filter": f"WITH {_CHUNKS} SELECT chunk_id, len(list_filter(regexp_extract_all(lower(content), '{_PART}'), lambda t: t NOT IN {_STOP})) AS n_terms FROM ch",
    "token_length_stats": f"WITH {_CHUNKS}, w AS (SELECT CASE WHEN c = '' THEN 0 ELSE len(regexp_split_to_array(c, '\\s+')) END AS n FROM (SELECT regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS c FROM ch)) SELECT round(avg(n), 6) AS avg_len, max(n) AS max_len, min(n) AS min_len, bool_or(n > 256) AS any_over FROM w",
    "corpus_stats": f"WITH {_CHUNKS}, {_ALL}, {_TERMS} SELECT (SELECT count(*) FROM ch) AS n_chunks, round((SELECT count(*) FROM tm)::DOUBLE / (SELECT count(*) FROM ch), 6) AS avgdl",
    "doc_freq": f"WITH {_CHUNKS}, {_ALL}, {_TERMS} SELECT term, count(DISTINCT chunk_id) AS df FROM tm GROUP BY term",
    "term_freq": f"WITH {_CHUNKS}, {_ALL}, {_TERMS}, {_TF} SELECT chunk_id, term, tf FROM tf",
    "bm25_impact": f"WITH {_POST} SELECT term, chunk_id, tf, round(impact, 6) AS impact FROM po",
    "bm25_search_topk": f"WITH {_search(_QUESTIONS)} SELECT question_id, rank::INT AS rank, chunk_id, score FROM tk",
    "bm25_single_query": f"WITH {_search(_fixed([('q', 'How does the gateway retry a snapshot of the vocabulary?')]))} SELECT question_id, rank::INT AS rank, chunk_id, score FROM tk",
    "bm25_pad_to_k": f"""WITH {_search(_fixed([("q1", "the of and"), ("q2", "nosuchtermatall"), ("q3", "quillcache")]))},
pa AS (SELECT qu.question_id, ch.chunk_id, coalesce(sc.score, 0.0) AS score FROM qu CROSS JOIN ch LEFT JOIN sc ON sc.question_id = qu.question_id AND sc.chunk_id = ch.chunk_id)
SELECT question_id, rank::INT AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM pa) WHERE rank < 10""",
    "vector_knn_topk": _knn("chunk_vectors", "chunk_id"),
    "unit_vector_knn": _knn("embeddings", "vec_id"),
    "vector_norms": "SELECT chunk_id, round(list_dot_product(e, e), 6) AS squared FROM (SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY chunk_id)",
    "rrf_score_table": "SELECT DISTINCT hit_rank AS rank, round(1.0::DOUBLE / (60 + hit_rank), 9) AS score FROM search_hits",
    "hybrid_rrf_topk": f"""WITH {_search(_QUESTIONS)}, {_HITS},
bo AS (SELECT question_id, chunk_id, rank, rank AS place FROM tk UNION ALL SELECT question_id, chunk_id, min(rank), 1000000000 + min(rank) FROM hi GROUP BY question_id, chunk_id),
fu AS (SELECT question_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(place) AS place FROM bo GROUP BY ALL)
SELECT question_id, rank::INT AS rank, chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, place) - 1 AS rank FROM fu) WHERE rank < 10""",
    "hybrid_vector_topk": f"""WITH {_vectors("chunk_vectors", "chunk_id")}, {_search("qu AS (SELECT chunk_id AS question_id, content AS question FROM ch WHERE chunk_id % 50 = 0 AND chunk_id IN (SELECT chunk_id FROM v))")},
vs AS (SELECT q.chunk_id AS question_id, v.chunk_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.chunk_id IN (SELECT question_id FROM qu)),
vk AS (SELECT * FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM vs) WHERE rank < 10),
bo AS (SELECT question_id, chunk_id, rank, rank AS place FROM tk UNION ALL SELECT question_id, chunk_id, rank, 1000000000 + rank FROM vk),
fu AS (SELECT question_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(place) AS place FROM bo GROUP BY ALL)
SELECT question_id, rank::INT AS rank, chunk_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, place) - 1 AS rank FROM fu) WHERE rank < 10""",
    "cache_lookup": f"WITH {_QUESTIONS}, {_HITS}, {_CACHE} SELECT question_id, rank, chunk_id, score FROM qu JOIN ca ON qu.question = ca.query",
    "cache_misses": f"WITH {_QUESTIONS}, {_HITS}, {_CACHE} SELECT question_id, question FROM qu WHERE question NOT IN (SELECT query FROM ca)",
    "cache_upsert": f"WITH {_HITS}, {_CACHE} SELECT query, rank, chunk_id, score FROM ca WHERE query NOT IN (SELECT query FROM ca WHERE rank = 0) UNION ALL SELECT query, rank, chunk_id, 0.0::DOUBLE FROM ca WHERE rank = 0",
    "citation_format": f"WITH {_HITS} SELECT question_id, rank, file_path || ' [' || start_index || ':' || end_index || ']' AS place FROM hi",
    "ranked_sources_json": f"WITH {_QUESTIONS}, {_HITS} SELECT question_id, question AS question_str, coalesce((SELECT string_agg(file_path || ' [' || start_index || ':' || end_index || ']', '; ' ORDER BY rank) FROM hi WHERE hi.question_id = qu.question_id), '') AS sources FROM qu",
    "context_prompt": f"WITH {_HITS} SELECT question_id, md5(c) AS context_md5, length(c)::INT AS n_chars FROM (SELECT question_id, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY rank), '') AS c FROM hi GROUP BY question_id)",
    "last_marker_strip": f"SELECT DISTINCT path, {_NAME} AS tail FROM source_files",
    "span_iou": f"WITH {_QUESTIONS}, {_HITS}, {_GOLD} SELECT question_id, gold_id::INT AS gold_id, rank, round({_IOU}, 9) AS iou FROM go JOIN hi USING (question_id, file_path)",
    "gold_hit_semi_join": f"WITH {_recall(10)} SELECT question_id, gold_id::INT AS gold_id, hit FROM gh",
    "recall_per_question": f"WITH {_recall(10)} SELECT question_id, n_gold, n_found, round(recall, 9) AS recall FROM pq",
    "recall_at_k": f"WITH {_recall(5)} SELECT count(*) AS n_questions, round(avg(recall), 9) AS recall FROM pq",
    "evaluate_multi_k": " UNION ALL ".join(f"SELECT {k} AS k, r AS recall FROM (WITH {_recall(k)} SELECT round(avg(recall), 9) AS r FROM pq)" for k in (1, 3, 5, 10)),
}
