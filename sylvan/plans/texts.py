"""Queries over file contents, ranked retrieval, incremental maintenance and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.kinds import IMPLEMENTATION_BIAS, LOW_VALUE, WEIGHT, case_sql
from sylvan.functions.terms import match_terms, title_case
from sylvan.operators import hybrid, sync, text_search
from sylvan.plans.symbols import CUR, CURF, TEST_SQL, files, nodes
from sylvan.streaming import changes
from sylvan.tables import read

WORDS = ["lock", "queue", "merge", "deadline"]
TASK = "How does bind_frame drain the parcel queue when the pair_shard lock is held?"
T = hybrid.Task.of(TASK)


def contents(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "file_contents").groupBy("path").agg(F.max("content").alias("content"))


def bm25(s: SparkSession, d: str) -> DataFrame:
    return text_search.bm25(contents(s, d), "path", "content", WORDS).select("path", F.round("score", 6).alias("score"))


def documents_bm25(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").select("doc_id", "text")
    return text_search.bm25(docs, "doc_id", "text", ["ambiguous", "retries", "symbol"]).select("doc_id", F.round("score", 6).alias("score"))


def proximity(s: SparkSession, d: str) -> DataFrame:
    return text_search.proximity(contents(s, d), "path", "content", WORDS)


def clusters(s: SparkSession, d: str) -> DataFrame:
    some = nodes(s, d).filter(F.col("kind").isin("function", "method")).select("file_path", "start_line", "end_line")
    return text_search.line_clusters(some, "file_path")


def term_counts(s: SparkSession, d: str) -> DataFrame:
    index = text_search.inverted_index(contents(s, d), "path", "content")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def diff(s: SparkSession, d: str) -> DataFrame:
    return sync.classify(files(s, d), sync.scan_rows(read(s, d, "file_contents")))


def gone(s: SparkSession, d: str) -> DataFrame:
    return diff(s, d).filter(F.col("state").isin("deleted", "changed")).select("path")


def prune_nodes(s: SparkSession, d: str) -> DataFrame:
    left, _ = sync.remove_files(nodes(s, d), read(s, d, "edges"), gone(s, d))
    return left.select("id", "file_path")


def prune_edges(s: SparkSession, d: str) -> DataFrame:
    _, kept = sync.remove_files(nodes(s, d), read(s, d, "edges"), gone(s, d))
    return kept.select("edge_seq")


def requeued(s: SparkSession, d: str) -> DataFrame:
    return sync.requeue_incoming(read(s, d, "edges"), nodes(s, d), gone(s, d))


def replaced(s: SparkSession, d: str) -> DataFrame:
    """Records of changed paths replaced by what the scan found."""
    stored = files(s, d).select("path", "size", "content_hash")
    fresh = sync.scan_rows(read(s, d, "file_contents"))
    return sync.replace_rows(stored, fresh.select("path", "size", "content_hash"), "path")


def streamed_files(s: SparkSession, d: str) -> DataFrame:
    return changes.apply_feed(changes.file_stream(s, d, "files"), "path", "indexed_at").select("path", "size", "indexed_at")


def lines_of(s: SparkSession, d: str) -> DataFrame:
    from sylvan.functions.columns import text_lines

    return contents(s, d).select("path", F.size(text_lines(F.col("content"))).cast("bigint").alias("n_lines"))


def scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 4).alias("score"))


def explore_by_file(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).filter(~F.col("kind").isin(*LOW_VALUE)).withColumn("hits", hybrid.group_hits(T)).filter("hits >= 2")
    return n.groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.sum("hits").alias("n_hits"), F.min("start_line").alias("first_line"))


def capped(s: SparkSession, d: str) -> DataFrame:
    ranked = nodes(s, d).select("id", "file_path", F.col("end_line").cast("double").alias("score"))
    return hybrid.diversity_cap(ranked, 100).select("id")


def uncommon(s: SparkSession, d: str) -> DataFrame:
    ranked = nodes(s, d).select("id", "file_path", F.col("end_line").cast("double").alias("score"))
    return hybrid.non_prod_cap(ranked, 100).select("id")


QUERIES = {
    "bm25_search": bm25,
    "bm25_documents": documents_bm25,
    "proximity_window": proximity,
    "line_clusters": clusters,
    "term_statistics": term_counts,
    "line_counts": lines_of,
    "sync_diff": diff,
    "sync_apply_nodes": prune_nodes,
    "sync_apply_edges": prune_edges,
    "sync_requeue": requeued,
    "sync_replace": replaced,
    "stream_sync_latest": streamed_files,
    "stream_change_windows": lambda s, d: changes.run_complete(changes.change_windows(changes.file_stream(s, d, "events")), "windows"),
    "stream_sessions": lambda s, d: changes.run_complete(changes.edit_sessions(changes.file_stream(s, d, "events")), "sessions"),
    "hybrid_exact": lambda s, d: scored(hybrid.exact_arm(nodes(s, d), T)),
    "hybrid_like": lambda s, d: scored(hybrid.like_arm(nodes(s, d), T)),
    "hybrid_prefix": lambda s, d: scored(hybrid.prefix_arm(nodes(s, d), T)),
    "hybrid_compound": lambda s, d: scored(hybrid.compound_arm(nodes(s, d), T)),
    "hybrid_content": lambda s, d: scored(hybrid.content_arm(nodes(s, d), read(s, d, "file_contents"), T)),
    "hybrid_search": lambda s, d: hybrid.hybrid_search(nodes(s, d), read(s, d, "file_contents"), TASK),
    "hybrid_search_all": lambda s, d: hybrid.hybrid_search(nodes(s, d), read(s, d, "file_contents"), TASK),
    "explore_by_file": explore_by_file,
    "file_diversity_cap": capped,
    "non_prod_cap": uncommon,
}

_ONE = "one AS (SELECT path, max(content) AS content FROM file_contents GROUP BY path)"
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25(source: str, key: str, text: str, terms: list[str]) -> str:
    parts, some = [], []
    for i, t in enumerate(sorted(terms)):
        idf = f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6)"
        parts.append(f"CASE WHEN tf{i} > 0 THEN {idf} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END")
        some.append(f"tf{i} > 0")
    tfs = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(sorted(terms)))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    return f"""t AS (SELECT {key}, {_TOK.format(text)} AS w FROM {source}), c AS (SELECT {key}, len(w) AS length, {tfs} FROM t), f AS (SELECT count(*) AS n, avg(length) AS mean, {dfs} FROM c)
SELECT {key}, round({' + '.join(parts)}, 6) AS score FROM c, f WHERE {' OR '.join(some)}"""


_LINES = "l AS (SELECT path, unnest(string_split(regexp_replace(regexp_replace(replace(lower(content), chr(13) || chr(10), chr(10)), '\\n$', ''), 'never-matches-anything', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(replace(lower(content), chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)), 1) AS line_no FROM one)"
_H = ", ".join(f"contains(line, '{t}')::INT AS h{i}" for i, t in enumerate(WORDS))
_HS = " + ".join(f"h{i}" for i in range(len(WORDS)))
_WIN = "OVER (PARTITION BY path ORDER BY line_no RANGE BETWEEN CURRENT ROW AND 79 FOLLOWING)"
_GONE = f"""scan AS (SELECT path, strlen(content)::BIGINT AS size, sha256(content) AS content_hash FROM one),
diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
WHEN a.size IS NOT DISTINCT FROM b.size AND a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM curf a FULL JOIN scan b ON a.path = b.path),
gone AS (SELECT path FROM diff WHERE state IN ('deleted', 'changed')), dead AS (SELECT id FROM cur WHERE file_path IN (SELECT path FROM gone))"""
_W = case_sql(WEIGHT, "kind", 0)
_REL = "8 * (" + " + ".join(f"contains(lower(file_path), '{t}')::INT" for t in T.terms) + ")"
_HAY = "lower(concat_ws(' ', name, qualified_name, file_path, coalesce(signature, '')))"
_HITS = " + ".join("(" + " OR ".join(f"contains({_HAY}, '{t}')" for t in g) + ")::INT" for g in T.groups)
_LOW = ", ".join(f"'{k}'" for k in LOW_VALUE)
_DEF = "'class', 'struct', 'interface', 'trait', 'protocol', 'function', 'method', 'enum', 'type_alias', 'component'"
_ARMS = f"""{CUR}, hits AS (SELECT *, {_HITS} AS hits, {_W} AS kw, {_REL} AS rel FROM cur),
terms AS (SELECT unnest([{', '.join(f"'{t}'" for t in T.terms)}]) AS term), titles AS (SELECT unnest([{', '.join(f"'{title_case(t)}'" for t in T.terms if len(t) >= 3)}]) AS title),
a_exact AS (SELECT id, round(120.0 + kw + rel, 6) AS score FROM hits WHERE name IN ({', '.join(f"'{x}'" for x in T.symbols)})),
a_like AS (SELECT id, max(score) AS score FROM (SELECT id, round((55.0 + kw + CASE WHEN lower(name) = term THEN 45 ELSE 30 END + rel) * CASE WHEN {TEST_SQL.format('file_path')} THEN 0.35 ELSE 1.0 END, 6) AS score
  FROM hits JOIN terms ON starts_with(lower(name), term) WHERE kind NOT IN ({_LOW}) QUALIFY row_number() OVER (PARTITION BY term ORDER BY CASE WHEN name = term THEN 0 ELSE 1 END, length(name), file_path, start_line, id) <= 20) GROUP BY id),
a_prefix AS (SELECT id, max(score) AS score FROM (SELECT id, round(75.0 + kw + greatest(0.0, 10.0 - (length(name) - length(title)) / 3.0) + rel, 6) AS score FROM hits JOIN titles ON starts_with(name, title)
  WHERE kind IN ({_DEF}) QUALIFY row_number() OVER (PARTITION BY title ORDER BY length(name), file_path, start_line, id) <= 15) GROUP BY id),
a_compound AS (SELECT id, round(score, 6) AS score FROM (SELECT *, 70.0 + 24.0 * hits + kw + rel + greatest(0.0, 10.0 - length(name) / 6.0) AS score FROM hits WHERE kind NOT IN ({_LOW}) AND hits >= 2) ORDER BY score DESC, length(name), file_path, start_line, id LIMIT 5)"""


def _words_tf(term: str) -> str:
    parts = [p for p in term.split("_") if p]
    same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: coalesce({same}, false)))::DOUBLE"


_M = sorted({t.lower() for t in match_terms(TASK)})
_N = range(len(T.terms))
_RANK = " + ".join(
    f"CASE WHEN tf{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END" for i in range(len(_M))
)
_CH = " + ".join(f"h{i}" for i in _N)
_CWIN = "OVER (PARTITION BY path ORDER BY line_no RANGE BETWEEN CURRENT ROW AND 79 FOLLOWING)"
#: the content arm after ``_ARMS``: a_content (id, score)
CONTENT_SQL = f"""{_ONE}, {_LINES}, c_t AS (SELECT path, {_TOK.format('content')} AS w FROM one WHERE path IS NOT NULL),
c_c AS (SELECT path, len(w) AS length, {', '.join(f'{_words_tf(t)} AS tf{i}' for i, t in enumerate(_M))} FROM c_t),
c_f AS (SELECT count(*) AS n, avg(length) AS mean, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}' for i in range(len(_M)))} FROM c_c),
c_rank AS (SELECT path, {_RANK} AS rank FROM c_c, c_f WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(_M)))} ORDER BY rank DESC, path LIMIT 20),
c_h AS (SELECT path, line_no, {', '.join(f"contains(line, '{t}')::INT AS h{i}" for i, t in enumerate(T.terms))} FROM l), c_k AS (SELECT * FROM c_h WHERE {_CH} > 0),
c_w AS (SELECT path, line_no, {' + '.join(f'max(h{i}) {_CWIN}' for i in _N)} AS n, sum({_CH}) {_CWIN} AS density FROM c_k),
c_b AS (SELECT * FROM c_w QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, density DESC, line_no) = 1),
c_near AS (SELECT b.path AS file_path, any_value(b.n) AS n, any_value(b.density) AS density, list(k.line_no) AS at, {', '.join(f'max(h{i}) AS m{i}' for i in _N)}
  FROM c_b b JOIN c_k k ON k.path = b.path AND k.line_no BETWEEN b.line_no AND b.line_no + 79 GROUP BY b.path),
c_base AS (SELECT *, {_REL} + 18 * (n - 1) + 3 * greatest(density - n, 0) AS base FROM c_near),
c_first AS (SELECT b.*, 40 + r.rank + 22 * n + base AS file_score FROM c_base b JOIN c_rank r ON r.path = b.file_path),
c_files AS (SELECT * FROM (SELECT * FROM c_first UNION ALL SELECT *, 20 * n + base FROM c_base WHERE NOT EXISTS (SELECT 1 FROM c_first)) ORDER BY file_score DESC, n DESC, file_path LIMIT 15),
c_n AS (SELECT h.*, f.file_score, {' + '.join(f"m{i} * contains({_HAY.replace('file_path', 'h.file_path')}, '{t}')::INT" for i, t in enumerate(T.terms))} AS node_hits,
  list_min(list_transform(f.at, lambda x: greatest(h.start_line - x, x - greatest(h.end_line, h.start_line), 0))) AS far FROM hits h JOIN c_files f ON f.file_path = h.file_path WHERE h.kind NOT IN ({_LOW})),
c_s AS (SELECT *, round((38.0 + file_score + kw + {case_sql(IMPLEMENTATION_BIAS, 'kind', 0)} + 18 * node_hits + CASE WHEN far = 0 THEN 35 WHEN far <= 5 THEN 24 WHEN far <= 25 THEN 12 ELSE 0 END)
  * CASE WHEN {TEST_SQL.format('file_path')} THEN 0.35 ELSE 1.0 END, 6) AS score FROM c_n),
c_up AS (SELECT s.*, o.id AS oid, o.start_line AS ostart, row_number() OVER (PARTITION BY s.id ORDER BY greatest(o.end_line - o.start_line, 0), o.start_line, o.start_column, o.end_line DESC, o.id) AS pick
  FROM c_s s LEFT JOIN cur o ON s.kind IN ('variable', 'field', 'property') AND o.kind IN ('function', 'method', 'class', 'struct', 'interface', 'trait') AND o.file_path = s.file_path
  AND o.start_line <= s.start_line AND greatest(o.end_line, o.start_line) >= s.start_line AND o.id <> s.id),
c_top AS (SELECT coalesce(oid, id) AS id, score FROM c_up WHERE pick = 1
  QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, node_hits DESC, coalesce(ostart, start_line), start_line, start_column, end_line DESC, id) <= 5),
a_content AS (SELECT id, max(score) AS score FROM c_top GROUP BY id)"""
_CAP = "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY end_line DESC, id) AS r FROM cur) WHERE r <= 20"
_NONPROD = f"({TEST_SQL.format('file_path')} OR regexp_matches(lower(file_path), '/(example|examples|sample|samples|fixture|fixtures|mock|mocks)/'))"

SQL = {
    "bm25_search": f"WITH {_ONE}, " + _bm25("one", "path", "content", WORDS),
    "bm25_documents": "WITH " + _bm25("documents", "doc_id", "text", ["ambiguous", "retries", "symbol"]),
    "proximity_window": f"""WITH {_ONE}, {_LINES}, h AS (SELECT path, line_no, {_H} FROM l), k AS (SELECT * FROM h WHERE {_HS} > 0),
w AS (SELECT path, line_no, {' + '.join(f'max(h{i}) {_WIN}' for i in range(len(WORDS)))} AS n_terms, sum({_HS}) {_WIN} AS density FROM k)
SELECT path, line_no::BIGINT AS line_no, n_terms::BIGINT AS n_terms, density::BIGINT AS density FROM w QUALIFY row_number() OVER (PARTITION BY path ORDER BY n_terms DESC, density DESC, line_no) = 1""",
    "line_clusters": f"""WITH {CUR}, p AS (SELECT DISTINCT file_path, greatest(start_line - 3, 1) AS s, greatest(end_line, start_line) + 3 AS e FROM cur WHERE kind IN ('function', 'method')),
q AS (SELECT *, max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
r AS (SELECT *, sum((seen IS NULL OR s > seen + 5)::INT) OVER (PARTITION BY file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM q)
SELECT file_path, min(s) AS start_line, max(e) AS end_line FROM r GROUP BY file_path, island""",
    "term_statistics": f"WITH {_ONE}, t AS (SELECT path, unnest({_TOK.format('content')}) AS term FROM one), c AS (SELECT path, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY term",
    "line_counts": f"WITH {_ONE}, {_LINES} SELECT path, count(*) AS n_lines FROM l GROUP BY path",
    "sync_diff": f"WITH {CUR}, {CURF}, {_ONE}, {_GONE} SELECT path, state FROM diff",
    "sync_apply_nodes": f"WITH {CUR}, {CURF}, {_ONE}, {_GONE} SELECT id, file_path FROM cur WHERE id NOT IN (SELECT id FROM dead)",
    "sync_apply_edges": f"WITH {CUR}, {CURF}, {_ONE}, {_GONE} SELECT edge_seq FROM edges WHERE coalesce(source, '') NOT IN (SELECT id FROM dead) AND coalesce(target, '') NOT IN (SELECT id FROM dead)",
    "sync_requeue": f"""WITH {CUR}, {CURF}, {_ONE}, {_GONE} SELECT s.id AS from_node_id, t.name AS reference_name, e.kind AS reference_kind, e.line, e.col, s.file_path, s.language
FROM edges e JOIN cur t ON t.id = e.target AND t.file_path IN (SELECT path FROM gone) JOIN cur s ON s.id = e.source WHERE s.file_path <> t.file_path""",
    "sync_replace": f"""WITH {CUR}, {CURF}, {_ONE}, {_GONE} SELECT path, size, content_hash FROM curf WHERE path NOT IN (SELECT path FROM scan) UNION ALL SELECT path, size, content_hash FROM scan""",
    "stream_sync_latest": f"WITH {CURF} SELECT path, size, indexed_at FROM curf",
    "stream_change_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, k""",
    "hybrid_exact": f"WITH {_ARMS} SELECT id, round(score, 4)::DOUBLE AS score FROM a_exact",
    "hybrid_like": f"WITH {_ARMS} SELECT id, round(score, 4)::DOUBLE AS score FROM a_like",
    "hybrid_prefix": f"WITH {_ARMS} SELECT id, round(score, 4)::DOUBLE AS score FROM a_prefix",
    "hybrid_compound": f"WITH {_ARMS} SELECT id, round(score, 4)::DOUBLE AS score FROM a_compound",
    "hybrid_content": f"WITH {_ARMS}, {CONTENT_SQL} SELECT id, round(score, 4)::DOUBLE AS score FROM a_content",
    "hybrid_search": f"""WITH {_ARMS}, fused AS (SELECT id, max(score) AS score, arg_max(arm, (score, arm)) AS arm FROM (SELECT *, 'exact' AS arm FROM a_exact UNION ALL SELECT *, 'like' FROM a_like
UNION ALL SELECT *, 'prefix' FROM a_prefix UNION ALL SELECT *, 'compound' FROM a_compound) GROUP BY id),
boost AS (SELECT f.id, h.name, h.file_path, h.start_line, f.arm, CASE WHEN h.hits >= 2 THEN f.score * (1 + 0.35 * h.hits) ELSE f.score * 0.62 END AS score FROM fused f JOIN hits h ON h.id = f.id),
named AS (SELECT file_path, count(DISTINCT lower(name)) AS k FROM boost WHERE lower(name) IN ({', '.join(f"'{x.lower()}'" for x in T.symbols)}) GROUP BY file_path)
SELECT b.id, b.name, b.file_path, b.start_line, round(b.score + CASE WHEN n.k >= 2 THEN 20 * (n.k - 1) ELSE 0 END, 4) AS score, b.arm FROM boost b LEFT JOIN named n ON n.file_path = b.file_path ORDER BY score DESC, b.id LIMIT 20""",
    "hybrid_search_all": f"""WITH {_ARMS}, {CONTENT_SQL}, fused AS (SELECT id, max(score) AS score, arg_max(arm, (score, arm)) AS arm FROM (SELECT *, 'exact' AS arm FROM a_exact UNION ALL SELECT *, 'like' FROM a_like
UNION ALL SELECT *, 'prefix' FROM a_prefix UNION ALL SELECT *, 'compound' FROM a_compound UNION ALL SELECT *, 'content' FROM a_content) GROUP BY id),
boost AS (SELECT f.id, h.name, h.file_path, h.start_line, f.arm, CASE WHEN h.hits >= 2 THEN f.score * (1 + 0.35 * h.hits) ELSE f.score * 0.62 END AS score FROM fused f JOIN hits h ON h.id = f.id),
named AS (SELECT file_path, count(DISTINCT lower(name)) AS k FROM boost WHERE lower(name) IN ({', '.join(f"'{x.lower()}'" for x in T.symbols)}) GROUP BY file_path)
SELECT b.id, b.name, b.file_path, b.start_line, round(b.score + CASE WHEN n.k >= 2 THEN 20 * (n.k - 1) ELSE 0 END, 4) AS score, b.arm FROM boost b LEFT JOIN named n ON n.file_path = b.file_path ORDER BY score DESC, b.id LIMIT 20""",
    "explore_by_file": f"WITH {_ARMS} SELECT file_path, count(*) AS n_symbols, sum(hits)::BIGINT AS n_hits, min(start_line) AS first_line FROM hits WHERE kind NOT IN ({_LOW}) AND hits >= 2 GROUP BY file_path",
    "file_diversity_cap": f"WITH {CUR} {_CAP}",
    "non_prod_cap": f"""WITH {CUR}, f AS (SELECT id, end_line, {_NONPROD} AS np FROM cur) SELECT id FROM f WHERE NOT np UNION ALL SELECT id FROM (SELECT id FROM f WHERE np ORDER BY end_line DESC, id LIMIT 15)""",
}
