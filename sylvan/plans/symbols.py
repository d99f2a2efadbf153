"""Queries over symbols: search, statistics, places, export. Each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import columns as C
from sylvan.functions import kinds as K
from sylvan.functions.terms import STOP_WORDS
from sylvan.operators import export, search
from sylvan.tables import NODES, current_files, current_nodes, read

CUR = "cur AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
CURF = "curf AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1)"
BASE = "regexp_extract(lower({0}), '([^/]*)$', 1)"
TEST_SQL = f"(regexp_matches(lower({{0}}), '{C.TEST_PATH}') OR regexp_matches({BASE}, '{C.TEST_NAME}'))"
NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
SINCE = 1_750_000_000_000


def nodes(s: SparkSession, d: str) -> DataFrame:
    return current_nodes(read(s, d, "nodes"))


def files(s: SparkSession, d: str) -> DataFrame:
    return current_files(read(s, d, "files"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def totals(s: SparkSession, d: str) -> DataFrame:
    refs = read(s, d, "unresolved_refs")
    parts = [
        ("nodes", nodes(s, d)),
        ("edges", read(s, d, "edges")),
        ("files", files(s, d)),
        ("unresolved_refs", refs),
        ("pending_refs", refs.filter(F.col("resolution_status").isNull())),
    ]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def stats_all(s: SparkSession, d: str) -> DataFrame:
    """Nodes by kind and by language and in all, in one pass (grouping sets)."""
    n = nodes(s, d).select("kind", "language")
    n.createOrReplaceTempView("_sylvan_stats")
    return s.sql("SELECT kind, language, count(*) AS n FROM _sylvan_stats GROUP BY GROUPING SETS ((kind), (language), ())")


def points(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "unresolved_refs").select("file_path", "line", "col")


def kind_attributes(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return n.select(
        "id",
        K.lookup(K.WEIGHT, F.col("kind"), 0).alias("kind_weight"),
        K.lookup(K.IMPLEMENTATION_BIAS, F.col("kind"), 0).alias("impl_bias"),
        K.lookup(K.RESOLUTION_SCORE, F.col("kind"), 2).alias("resolution_score"),
        K.lookup(K.TAG_LETTER, F.col("kind"), "u").alias("tag_letter"),
    )


def metadata(s: SparkSession, d: str) -> DataFrame:
    from sylvan.tables import latest

    return latest(read(s, d, "project_metadata"), "key", "updated_at").select("key", "value")


def node_hash(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return n.select("id", C.node_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line")).alias("hash_id"))


def members(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    tree = search.enclosing_parent(n, K.CONTAINERS)
    return tree.groupBy("parent_id").agg(F.count("*").alias("n_members"))


def display_signature(s: SparkSession, d: str) -> DataFrame:
    first = F.trim(F.split("signature", "\n")[0])
    return nodes(s, d).filter("signature is not null").select("id", F.regexp_replace(first, r"\s*\{+$", "").alias("shown"))


QUERIES = {
    "search_prefix": lambda s, d: search.search_symbols(nodes(s, d), "resolve"),
    "search_wildcard": lambda s, d: search.search_symbols(nodes(s, d), "*_queue"),
    "search_single_wildcard": lambda s, d: search.search_symbols(nodes(s, d), "seal_?o*"),
    "search_by_kind": lambda s, d: search.search_symbols(nodes(s, d), "*pool*", "method"),
    "node_names_prefix": lambda s, d: search.node_names(nodes(s, d), "par"),
    "bind_symbol": lambda s, d: search.bind_names(nodes(s, d), read(s, d, "unresolved_refs"), "reference_name").drop("rank"),
    "name_candidates": lambda s, d: search.bind_names(nodes(s, d), read(s, d, "unresolved_refs"), "reference_name", 50),
    "workspace_symbols": lambda s, d: search.workspace_symbols(nodes(s, d), "merge"),
    "node_at_position": lambda s, d: search.innermost_at(nodes(s, d), points(s, d)),
    "document_symbol_parent": lambda s, d: search.enclosing_parent(nodes(s, d)),
    "container_members": members,
    "nodes_by_file_order": lambda s, d: nodes(s, d)
    .select("file_path", "id", "start_line", "start_column", "end_line")
    .orderBy("file_path", "start_line", "start_column", F.desc("end_line")),
    "recent_files": lambda s, d: files(s, d).filter(F.col("modified_at") > SINCE).select("path", "modified_at"),
    "files_by_language": lambda s, d: count_by(files(s, d), "language"),
    "file_node_counts": lambda s, d: count_by(nodes(s, d), "file_path"),
    "stats_nodes_by_kind": lambda s, d: count_by(nodes(s, d), "kind"),
    "stats_nodes_by_language": lambda s, d: count_by(nodes(s, d), "language"),
    "stats_edges_by_kind": lambda s, d: read(s, d, "edges").groupBy(K.known_edge_kind(F.col("kind")).alias("kind")).agg(F.count("*").alias("n")),
    "stats_totals": totals,
    "stats_grouping_sets": stats_all,
    "distinct_names": lambda s, d: nodes(s, d).select("name").distinct(),
    "project_metadata_current": metadata,
    "kind_attributes": kind_attributes,
    "node_id_hash": node_hash,
    "content_hash": lambda s, d: read(s, d, "file_contents").select("path", F.sha2("content", 256).alias("content_hash")).distinct(),
    "split_identifier": lambda s, d: nodes(s, d).select("name").distinct().select("name", F.concat_ws(" ", C.identifier_parts(F.col("name"))).alias("parts")),
    "path_flags": lambda s, d: files(s, d).select(
        "path", C.is_test_file(F.col("path")).alias("is_test"), C.is_non_prod(F.col("path")).alias("is_non_prod"), C.is_header(F.col("path")).alias("is_header"),
        C.skipped_path(F.col("path")).alias("is_skipped"),
    ),
    "detect_language": lambda s, d: files(s, d).select("path", C.language_of(F.col("path")).alias("detected")),
    "signature_display": display_signature,
    "ctags_lines": lambda s, d: export.tag_lines(nodes(s, d)).select("line"),
    "nodes_json": lambda s, d: export.as_json(nodes(s, d)),
}


def _search(where: str, term: str, kind: str = "") -> str:
    return f"""WITH {CUR} SELECT id, name, kind, file_path, start_line, CASE WHEN name = '{term}' THEN 0 ELSE 1 END AS rank FROM cur
WHERE name ILIKE '{where}' {kind} ORDER BY rank, length(name), file_path, start_line, id LIMIT 20"""


def _bound(n: int) -> str:
    return f"""WITH {CUR}, keys AS (SELECT name AS key, 0 AS src, * FROM cur UNION ALL SELECT qualified_name, 1, * FROM cur WHERE qualified_name <> name),
want AS (SELECT DISTINCT reference_name AS wanted FROM unresolved_refs WHERE reference_name IS NOT NULL)
SELECT wanted, row_number() OVER (PARTITION BY wanted ORDER BY src, length(qualified_name), file_path, start_line, id) AS rank, id, kind, file_path
FROM want JOIN keys ON key = wanted QUALIFY rank <= {n}"""


_EXT = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in C.EXTENSIONS.items() if e != "sc")
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_TAG = lambda c: f"regexp_replace(replace({c}, '\\', '\\\\'), '[\\t\\r\\n]', ' ', 'g')"

SQL = {
    "search_prefix": _search("resolve%", "resolve"),
    "search_wildcard": _search("%_queue", "*_queue"),
    "search_single_wildcard": _search("seal__o%", "seal_?o"),
    "search_by_kind": _search("%pool%", "*pool", "AND kind = 'method'"),
    "node_names_prefix": f"WITH {CUR} SELECT DISTINCT name FROM cur WHERE name ILIKE 'par%' ORDER BY name LIMIT 50",
    "bind_symbol": f"SELECT wanted, id, kind, file_path FROM ({_bound(1)})",
    "name_candidates": _bound(50),
    "workspace_symbols": f"""WITH {CUR} SELECT id, name, kind, file_path, start_line, rank FROM (
SELECT *, {K.case_sql(K.WORKSPACE_RANK, 'kind', 5)} AS rank FROM cur WHERE name ILIKE '%merge%' AND kind NOT IN ('import', 'export', 'parameter')
QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY rank, start_line, id) <= 6) ORDER BY rank, start_line, file_path, id LIMIT 50""",
    "node_at_position": f"""WITH {CUR}, p AS (SELECT DISTINCT file_path, line, col FROM unresolved_refs WHERE line IS NOT NULL AND col IS NOT NULL)
SELECT p.file_path, p.line, p.col, n.id, n.name, n.kind FROM p JOIN cur n ON n.file_path = p.file_path
WHERE n.start_line <= p.line AND n.end_line >= p.line AND NOT (n.start_line = p.line AND n.start_column > p.col) AND NOT (n.end_line = p.line AND n.end_column < p.col)
QUALIFY row_number() OVER (PARTITION BY p.file_path, p.line, p.col ORDER BY n.end_line - n.start_line, n.start_line DESC, n.start_column DESC, n.id) = 1""",
    "document_symbol_parent": f"""WITH {CUR} SELECT c.id, o.id AS parent_id FROM cur c JOIN cur o ON o.file_path = c.file_path AND o.start_line <= c.start_line AND o.end_line >= c.end_line
AND o.end_line - o.start_line > c.end_line - c.start_line QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY o.end_line - o.start_line, o.start_line DESC, o.id) = 1""",
    "container_members": f"""WITH {CUR}, x AS (SELECT c.id, o.id AS parent_id FROM cur c JOIN cur o ON o.file_path = c.file_path AND o.start_line <= c.start_line AND o.end_line >= c.end_line
AND o.end_line - o.start_line > c.end_line - c.start_line WHERE o.kind IN ({', '.join(f"'{k}'" for k in K.CONTAINERS)})
QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY o.end_line - o.start_line, o.start_line DESC, o.id) = 1) SELECT parent_id, count(*) AS n_members FROM x GROUP BY parent_id""",
    "nodes_by_file_order": f"WITH {CUR} SELECT file_path, id, start_line, start_column, end_line FROM cur ORDER BY file_path, start_line, start_column, end_line DESC",
    "recent_files": f"WITH {CURF} SELECT path, modified_at FROM curf WHERE modified_at > {SINCE}",
    "files_by_language": f"WITH {CURF} SELECT language, count(*) AS n FROM curf GROUP BY language",
    "file_node_counts": f"WITH {CUR} SELECT file_path, count(*) AS n FROM cur GROUP BY file_path",
    "stats_nodes_by_kind": f"WITH {CUR} SELECT kind, count(*) AS n FROM cur GROUP BY kind",
    "stats_nodes_by_language": f"WITH {CUR} SELECT language, count(*) AS n FROM cur GROUP BY language",
    "stats_edges_by_kind": f"SELECT CASE WHEN kind IN ({', '.join(f"'{k}'" for k in K.EDGE_KINDS)}) THEN kind ELSE 'references' END AS kind, count(*) AS n FROM edges GROUP BY 1",
    "stats_totals": f"""WITH {CUR}, {CURF} SELECT 'nodes' AS relation, count(*) AS n FROM cur UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM curf
UNION ALL SELECT 'unresolved_refs', count(*) FROM unresolved_refs UNION ALL SELECT 'pending_refs', count(*) FROM unresolved_refs WHERE resolution_status IS NULL""",
    "stats_grouping_sets": f"WITH {CUR} SELECT kind, language, count(*) AS n FROM cur GROUP BY GROUPING SETS ((kind), (language), ())",
    "distinct_names": f"WITH {CUR} SELECT DISTINCT name FROM cur",
    "project_metadata_current": "SELECT key, value FROM project_metadata WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, value DESC) = 1",
    "kind_attributes": f"""WITH {CUR} SELECT id, {K.case_sql(K.WEIGHT, 'kind', 0)} AS kind_weight, {K.case_sql(K.IMPLEMENTATION_BIAS, 'kind', 0)} AS impl_bias,
{K.case_sql(K.RESOLUTION_SCORE, 'kind', 2)} AS resolution_score, {K.case_sql(K.TAG_LETTER, 'kind', 'u')} AS tag_letter FROM cur""",
    "node_id_hash": f"WITH {CUR} SELECT id, substr(sha256(concat_ws(':', file_path, kind, name, start_line::VARCHAR)), 1, 16) AS hash_id FROM cur",
    "content_hash": "SELECT DISTINCT path, sha256(content) AS content_hash FROM file_contents",
    "split_identifier": f"""WITH {CUR}, a AS (SELECT DISTINCT name FROM cur), b AS (SELECT name, lower(regexp_replace(regexp_replace(regexp_replace(name, '[_.\\-]', ' ', 'g'),
'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS t FROM a)
SELECT name, array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda p: length(p) >= 3 AND p NOT IN ({_STOP})), ' ') AS parts FROM b""",
    "path_flags": f"""WITH {CURF} SELECT path, {TEST_SQL.format('path')} AS is_test, {TEST_SQL.format('path')} OR regexp_matches(lower(path), '{C.SAMPLE_PATH}') AS is_non_prod,
regexp_matches(lower(replace(path, '\\', '/')), '{C.HEADER_PATH}') AS is_header, len(list_intersect(regexp_split_to_array(path, '[/\\\\]'), [{', '.join(f"'{k}'" for k in C.SKIPPED)}])) > 0 AS is_skipped FROM curf""",
    "detect_language": f"WITH {CURF} SELECT path, CASE regexp_extract(path, '\\.([^./\\\\]+)$', 1) {_EXT} END AS detected FROM curf",
    "signature_display": f"WITH {CUR} SELECT id, regexp_replace(trim(split_part(signature, chr(10), 1)), '\\s*\\{{+$', '') AS shown FROM cur WHERE signature IS NOT NULL",
    "ctags_lines": f"""WITH {CUR}, t AS (SELECT *, regexp_replace(regexp_replace(trim(signature), '\\{{+$', ''), '\\s+$', '') AS sig FROM cur WHERE kind NOT IN ('import', 'export', 'file', 'module'))
SELECT concat_ws(chr(9), {_TAG('name')}, {_TAG('file_path')}, greatest(start_line, 1)::VARCHAR || ';"', {K.case_sql(K.TAG_LETTER, 'kind', 'u')}, 'kind:' || kind, 'line:' || start_line,
'end:' || end_line, 'language:' || {K.case_sql(K.TAG_LANGUAGE, 'language', 'Python')}, CASE WHEN coalesce(qualified_name, '') <> '' THEN 'qualified:' || {_TAG('qualified_name')} END,
CASE WHEN coalesce(length(sig), 0) > 0 THEN 'signature:' || {_TAG('sig')} END) AS line FROM t""",
    "nodes_json": f"""WITH {CUR} SELECT json_merge_patch('{{}}', to_json({{{', '.join(f"'{c}': {c}" for c in NODE_COLUMNS)}}}))::VARCHAR AS json FROM cur""",
}
