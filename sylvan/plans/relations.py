"""Queries over edges and unresolved references, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.kinds import RESOLUTION_SCORE, case_sql
from sylvan.operators import graph, resolve
from sylvan.plans.symbols import CUR, CURF, files, nodes
from sylvan.staging import Staging
from sylvan.tables import read

SEED_SQL = """(SELECT source FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))
GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"""


def edges(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "edges")


def refs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "unresolved_refs")


def seed(s: SparkSession, d: str) -> DataFrame:
    """One start node: the one that calls most other nodes by id."""
    ids = nodes(s, d).select("id")
    calls = edges(s, d).filter("kind = 'calls'").select("source", "target").distinct()
    calls = calls.join(ids, F.col("target") == F.col("id"), "left_semi").join(ids, F.col("source") == F.col("id"), "left_semi")
    return calls.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")


def callee_seed(s: SparkSession, d: str) -> DataFrame:
    """The node called by most others: where an impact walk starts."""
    calls = graph.callers(nodes(s, d), edges(s, d)).groupBy(F.col("id").alias("node")).agg(F.countDistinct("caller_id").alias("n"))
    return calls.orderBy(F.desc("n"), "node").limit(1).select("node")


def fan_in(s: SparkSession, d: str) -> DataFrame:
    calls = graph.callers(nodes(s, d), edges(s, d))
    return calls.groupBy("id").agg(F.countDistinct("caller_id").alias("n")).select("id", F.least("n", F.lit(25)).alias("fan_in"))


def resolved(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    links = resolve.include_closure(resolve.imported_files(n, files(s, d)))
    return resolve.resolve_groups(refs(s, d), n, links)


def resolved_edges(s: SparkSession, d: str) -> DataFrame:
    st = Staging(s, "resolve")
    done = st.put(resolved(s, d), "groups")
    return resolve.retarget_edges(edges(s, d), nodes(s, d), done).select("edge_seq", "source", "target", "kind", "provenance")


def resolution_totals(s: SparkSession, d: str) -> DataFrame:
    return resolved(s, d).groupBy(F.coalesce("rule", "reason").alias("outcome")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_refs"))


def trackable(s: SparkSession, d: str) -> DataFrame:
    flagged = resolve.flag_builtins(refs(s, d))
    return flagged.select("ref_seq", "is_builtin", resolve.trackable(flagged).alias("is_trackable"))


QUERIES = {
    "callers": lambda s, d: graph.callers(nodes(s, d), edges(s, d)),
    "callees": lambda s, d: graph.callees(nodes(s, d), edges(s, d)),
    "callees_by_source_name": lambda s, d: graph.callees(nodes(s, d), edges(s, d), by_name=True),
    "references_to": lambda s, d: graph.references_to(nodes(s, d), edges(s, d)),
    "call_graph": lambda s, d: graph.call_graph(nodes(s, d), edges(s, d), nodes(s, d)),
    "call_graph_all": lambda s, d: graph.call_graph(nodes(s, d), edges(s, d), nodes(s, d)),
    "uncalled_functions": lambda s, d: graph.uncalled_functions(nodes(s, d), edges(s, d)),
    "fan_in": fan_in,
    "fan_in_topk": lambda s, d: graph.degree(edges(s, d), "target"),
    "fan_out_topk": lambda s, d: graph.degree(edges(s, d), "source"),
    "edges_for_node_counts": lambda s, d: edges(s, d)
    .select(F.explode(F.array_distinct(F.array("source", "target"))).alias("key"))
    .filter("key is not null")
    .groupBy("key")
    .agg(F.count("*").alias("n")),
    "bfs_levels": lambda s, d: graph.bfs(edges(s, d), seed(s, d), "calls", "out", 4),
    "bfs_both": lambda s, d: graph.bfs(edges(s, d), seed(s, d), None, "both", 2),
    "impact_radius": lambda s, d: graph.impact_radius(nodes(s, d), edges(s, d), callee_seed(s, d), 3),
    "shortest_path_hops": lambda s, d: graph.shortest_paths(edges(s, d), seed(s, d)).select("node", "hops", "parent"),
    "override_edges": lambda s, d: graph.override_edges(nodes(s, d), edges(s, d)),
    "top_level_contains": lambda s, d: graph.top_level(nodes(s, d), edges(s, d)),
    "local_target_resolution": lambda s, d: resolve.local_targets(nodes(s, d), edges(s, d)),
    "unresolved_groups": lambda s, d: resolve.unresolved_groups(refs(s, d)),
    "unresolved_groups_top": lambda s, d: resolve.unresolved_groups(refs(s, d), 100),
    "trackable_refs": trackable,
    "possible_names": lambda s, d: resolve.possible_names(refs(s, d), nodes(s, d)),
    "imported_files": lambda s, d: resolve.imported_files(nodes(s, d), files(s, d)),
    "include_closure": lambda s, d: resolve.include_closure(resolve.imported_files(nodes(s, d), files(s, d))),
    "resolve_groups": resolved,
    "resolve_totals": resolution_totals,
    "resolve_edges": resolved_edges,
}

_KEYS = "keys AS (SELECT id AS key, id, name FROM cur UNION SELECT name, id, name FROM cur)"


def _linked(kinds: str, ids: str, other: str) -> str:
    return f"""SELECT DISTINCT k.id AS {ids}, e.source AS {other}, e.line, e.col FROM (SELECT DISTINCT source, target, line, col FROM edges WHERE kind IN ({kinds})) e
JOIN keys k ON k.key = e.target JOIN cur s ON s.id = e.source"""


_CALLS = _linked("'calls'", "id", "caller_id")
_DIRECT = f"direct AS (SELECT DISTINCT caller_id AS caller, id AS callee_id FROM ({_CALLS}))"
_C = ", ".join(f"'{x}'" for x in resolve.C_FAMILY)
_BUILTIN = " UNION ALL ".join(f"SELECT '{lang}' AS language, unnest([{', '.join(repr(n) for n in sorted(set(ns)))}]) AS name" for lang, ns in resolve.NAMES.items())
_PREFIX = " OR ".join(f"starts_with(reference_name, '{p}')" for p in resolve.C_PREFIXES)
_BARE = "regexp_replace(regexp_replace(reference_name, '^[^A-Za-z0-9_]+', ''), '[^A-Za-z0-9_]+$', '')"
_FLAG = f"""builtin AS ({_BUILTIN}), flag AS (SELECT r.*, b.name IS NOT NULL OR (r.language IN ({_C}) AND ({_PREFIX})) AS is_builtin
FROM unresolved_refs r LEFT JOIN builtin b ON b.language = r.language AND b.name = r.reference_name)"""
_PIECES = """pieces AS (SELECT DISTINCT reference_name, p FROM (SELECT reference_name, unnest(list_concat([reference_name], string_split(reference_name, '.'), string_split(reference_name, ':'),
string_split(reference_name, '/'), string_split(reference_name, chr(92)))) AS p FROM (SELECT DISTINCT reference_name FROM unresolved_refs)) WHERE p <> ''),
possible AS (SELECT DISTINCT reference_name FROM pieces JOIN (SELECT DISTINCT name FROM cur) c ON c.name = p OR c.name = upper(substr(p, 1, 1)) || substr(p, 2))"""
_HEADER = "regexp_matches(lower(replace({0}, chr(92), '/')), '\\.(h|hh|hpp|hxx)$|/hdr/|/hdr_|_hdr/')"
_IMPORTS = f"""imp AS (SELECT file_path, language, trim(unnest([name, signature])) AS text FROM cur WHERE kind = 'import'),
ipath AS (SELECT DISTINCT file_path, language, CASE WHEN language IN ('javascript', 'typescript', 'jsx', 'tsx') THEN nullif(regexp_extract(text, '["'']([^"'']*)["''][^"'']*$', 1), '')
  WHEN language = 'python' THEN regexp_replace(regexp_replace(text, '^(?:from|import)\\s+', ''), '[\\s,].*$', '')
  ELSE regexp_replace(regexp_replace(text, '^#?\\s*(?:include\\s*)?[<"'' \\t]*', ''), '[>"'' \\t;]*$', '') END AS path FROM imp WHERE text IS NOT NULL),
ibase AS (SELECT file_path, language, path, CASE WHEN starts_with(path, '.') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(path, '^\\./', '')
  WHEN language = 'python' THEN replace(path, '.', '/') ELSE path END AS base FROM ipath WHERE path IS NOT NULL AND path <> ''),
itry AS (SELECT file_path, base || unnest(CASE WHEN language IN ('javascript', 'typescript', 'jsx', 'tsx') THEN ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']
  WHEN language = 'python' THEN ['', '.py', '/__init__.py'] WHEN language = 'rust' THEN ['', '.rs', '/mod.rs'] WHEN language IN ({_C}) THEN ['', '.h', '.hpp', '.c', '.cpp'] ELSE [''] END) AS target_path FROM ibase),
imported AS (SELECT file_path, target_path FROM itry WHERE target_path IN (SELECT path FROM curf)
  UNION SELECT i.file_path, f.path FROM ibase i JOIN curf f ON regexp_extract(f.path, '([^/\\\\]+)$', 1) = regexp_extract(i.path, '([^/\\\\]+)$', 1) WHERE i.language IN ({_C}) AND {_HEADER.format('f.path')}),
closure(file_path, target_path, depth) AS (SELECT file_path, target_path, 0 FROM imported UNION SELECT c.file_path, i.target_path, c.depth + 1 FROM closure c JOIN imported i ON i.file_path = c.target_path WHERE c.depth < 4)"""
_PREF = """CASE WHEN regexp_matches({0}, '/hdr_unix_win/|_unix_win/|/unix_win/') THEN 0 WHEN regexp_matches({0}, '/hdr_unix/|_unix/|/unix/') THEN 2 WHEN regexp_matches({0}, '/hdr_win/|_win/|/win/') THEN 3
WHEN regexp_matches({0}, '/hdr_vms/|_vms/|/vms/') THEN 8 WHEN contains({0}, '/hdr/') THEN 1 WHEN regexp_matches({0}, '/erold|/old') THEN 9 ELSE 5 END""".format("lower(replace(c.file_path, chr(92), '/'))")
_RESOLVED = f"""{CUR}, {CURF}, {_FLAG}, {_PIECES}, {_IMPORTS}, links AS (SELECT DISTINCT file_path, target_path FROM closure),
g AS (SELECT reference_name, reference_kind, file_path, language, count(*) AS n, bool_or(is_builtin) AS is_builtin FROM flag WHERE resolution_status IS NULL GROUP BY ALL HAVING true),
gp AS (SELECT g.*, reference_name IN (SELECT reference_name FROM possible) AS possible FROM (SELECT reference_name, reference_kind, file_path, language, sum(n)::BIGINT AS n, bool_or(is_builtin) AS is_builtin FROM g GROUP BY ALL) g),
keyed AS (SELECT name AS key, 0 AS src, * FROM cur UNION ALL SELECT qualified_name, 1, * FROM cur WHERE qualified_name <> name),
cand AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, length(qualified_name), file_path, start_line, id) AS spot FROM keyed QUALIFY spot <= 50),
pair AS (SELECT g.reference_name, g.reference_kind, g.file_path, g.language, c.id, c.spot, {case_sql(RESOLUTION_SCORE, 'c.kind', 2)} AS score, c.file_path AS c_path, c.start_line,
  l.target_path IS NOT NULL AS is_imported, c.kind IN ('function', 'method') AND NOT {_HEADER.format('c.file_path')} AS is_impl, g.reference_kind IN ('calls', 'instantiates') AS is_call, g.language IN ({_C}) AS is_c,
  {_PREF} AS header_rank, regexp_extract(g.file_path, '^(.*)[/\\\\][^/\\\\]*$', 1) <> '' AND starts_with(c.file_path, replace(regexp_extract(g.file_path, '^(.*)[/\\\\][^/\\\\]*$', 1), chr(92), '/')) AS near
  FROM gp g JOIN cand c ON c.key = g.reference_name LEFT JOIN links l ON l.file_path = g.file_path AND l.target_path = c.file_path WHERE g.possible AND NOT g.is_builtin),
pair2 AS (SELECT *, CASE WHEN is_call AND is_impl THEN 0 ELSE 1 END AS impl_rank, bool_or(is_impl) OVER (PARTITION BY reference_name, reference_kind, file_path, language) AS some_impl FROM pair),
pair3 AS (SELECT *, is_imported AND NOT (is_c AND is_call AND some_impl AND NOT is_impl) AS usable FROM pair2),
dec AS (SELECT reference_name, reference_kind, file_path, language, count(*) AS n_candidates, min(id) AS only_id,
  list(id ORDER BY impl_rank, header_rank, -score, c_path, start_line, id) FILTER (WHERE usable) AS imports, list(id ORDER BY impl_rank, header_rank, -score, c_path, start_line, id) FILTER (WHERE score >= 5) AS solid,
  list([impl_rank, header_rank, score] ORDER BY impl_rank, header_rank, -score, c_path, start_line, id) FILTER (WHERE score >= 5) AS solid_keys,
  arg_min(id, spot) FILTER (WHERE near) AS near_id, list(score ORDER BY score DESC) AS scores, list(id ORDER BY score DESC, spot) AS by_score FROM pair3 GROUP BY ALL),
same AS (SELECT name, file_path, arg_min(id, (start_line, start_column, id)) AS same_id FROM cur GROUP BY ALL),
res AS (SELECT gp.*, s.same_id, d.n_candidates, d.only_id, CASE WHEN gp.language IN ({_C}) OR len(d.imports) = 1 THEN d.imports[1] END AS import_id,
  CASE WHEN gp.language IN ({_C}) AND (len(d.solid) = 1 OR d.solid_keys[1] <> d.solid_keys[2]) THEN d.solid[1] END AS platform_id, d.near_id, CASE WHEN d.scores[2] IS NULL OR d.scores[1] <> d.scores[2] THEN d.by_score[1] END AS kind_id
  FROM gp LEFT JOIN same s ON s.name = gp.reference_name AND s.file_path = gp.file_path
  LEFT JOIN dec d ON d.reference_name = gp.reference_name AND d.reference_kind = gp.reference_kind AND d.file_path = gp.file_path AND d.language = gp.language),
res2 AS (SELECT *, NOT is_builtin AND possible AS live, CASE WHEN n_candidates = 1 THEN only_id END AS single_id FROM res),
final AS (SELECT reference_name, reference_kind, file_path, language, n, CASE WHEN live THEN coalesce(same_id, single_id, import_id, platform_id, near_id, kind_id) END AS node_id,
  CASE WHEN NOT live THEN NULL WHEN same_id IS NOT NULL THEN 'same_file' WHEN single_id IS NOT NULL THEN 'only_candidate' WHEN import_id IS NOT NULL THEN 'imported_file' WHEN platform_id IS NOT NULL THEN 'platform'
  WHEN near_id IS NOT NULL THEN 'same_folder' WHEN kind_id IS NOT NULL THEN 'kind' END AS rule, is_builtin, possible FROM res2),
out AS (SELECT reference_name, reference_kind, file_path, language, n, node_id, rule, CASE WHEN node_id IS NOT NULL THEN NULL WHEN is_builtin THEN 'external_builtin' WHEN NOT possible THEN 'not_found'
  WHEN language IN ({_C}) AND (contains(reference_name, '.') OR contains(reference_name, '::')) THEN 'member_call_no_receiver_type' WHEN language = 'cpp' AND regexp_matches(reference_name, '^[A-Z]') THEN 'framework_or_member_call'
  ELSE 'ambiguous_or_unresolved' END AS reason FROM final)"""

_CONT = """cont AS (SELECT coalesce(a.id, b.id) AS child, min(e.source) AS parent FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains') e JOIN cur s ON s.id = e.source
LEFT JOIN cur a ON a.id = e.target LEFT JOIN cur b ON b.qualified_name = e.target WHERE coalesce(a.id, b.id) IS NOT NULL GROUP BY 1)"""

SQL = {
    "callers": f"WITH {CUR}, {_KEYS} {_CALLS}",
    "callees": f"WITH {CUR}, {_KEYS}, {_DIRECT} SELECT caller AS id, callee_id FROM direct",
    "callees_by_source_name": f"""WITH {CUR}, {_KEYS}, {_DIRECT} SELECT DISTINCT b.id, d.callee_id FROM direct d JOIN cur a ON a.id = d.caller JOIN cur b ON b.name = a.name""",
    "references_to": f"WITH {CUR}, {_KEYS} {_linked("'references', 'imports', 'instantiates'", 'id', 'referrer_id')}",
    "call_graph": f"""WITH {CUR}, {_KEYS}, {_DIRECT} SELECT caller AS id, callee_id FROM direct WHERE caller IN (SELECT id FROM cur WHERE kind = 'method')
QUALIFY row_number() OVER (PARTITION BY caller ORDER BY callee_id) <= 100""",
    "call_graph_all": f"""WITH {CUR}, {_KEYS}, {_DIRECT} SELECT caller AS id, callee_id FROM direct QUALIFY row_number() OVER (PARTITION BY caller ORDER BY callee_id) <= 100""",
    "uncalled_functions": f"""WITH {CUR} SELECT id, name, file_path, start_line FROM cur n WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'calls' AND e.target = n.id)
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'calls' AND e.target = n.name)""",
    "fan_in": f"WITH {CUR}, {_KEYS}, c AS ({_CALLS}) SELECT id, least(count(DISTINCT caller_id), 25) AS fan_in FROM c GROUP BY id",
    "fan_in_topk": """SELECT target AS key, count(*) AS n FROM (SELECT DISTINCT source, target, line, col FROM edges WHERE kind = 'calls' AND target IS NOT NULL) GROUP BY 1 ORDER BY n DESC, key LIMIT 20""",
    "fan_out_topk": """SELECT source AS key, count(*) AS n FROM (SELECT DISTINCT source, target, line, col FROM edges WHERE kind = 'calls' AND source IS NOT NULL) GROUP BY 1 ORDER BY n DESC, key LIMIT 20""",
    "edges_for_node_counts": """SELECT key, count(*) AS n FROM (SELECT source AS key FROM edges WHERE source IS NOT NULL UNION ALL SELECT target FROM edges WHERE target IS NOT NULL AND target IS DISTINCT FROM source) GROUP BY key""",
    "bfs_levels": f"""WITH RECURSIVE walk(node, depth) AS (SELECT {SEED_SQL}, 0 UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.node WHERE e.kind = 'calls' AND e.target IS NOT NULL AND w.depth < 4)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "bfs_both": f"""WITH RECURSIVE l AS (SELECT source AS a, target AS b FROM edges WHERE source IS NOT NULL AND target IS NOT NULL UNION SELECT target, source FROM edges WHERE source IS NOT NULL AND target IS NOT NULL),
walk(node, depth) AS (SELECT {SEED_SQL}, 0 UNION SELECT l.b, w.depth + 1 FROM walk w JOIN l ON l.a = w.node WHERE w.depth < 2) SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "impact_radius": f"""WITH RECURSIVE {CUR}, {_KEYS}, calls AS (SELECT DISTINCT id, caller_id FROM ({_CALLS})),
walk(node, depth) AS (SELECT (SELECT id FROM calls GROUP BY id ORDER BY count(*) DESC, id LIMIT 1), 0 UNION SELECT c.caller_id, w.depth + 1 FROM walk w JOIN calls c ON c.id = w.node WHERE w.depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "shortest_path_hops": f"""WITH RECURSIVE l AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind = 'calls' AND source IS NOT NULL AND target IS NOT NULL),
walk(node, hops) AS (SELECT {SEED_SQL}, 0 UNION SELECT l.b, w.hops + 1 FROM walk w JOIN l ON l.a = w.node WHERE w.hops < 33), best AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node)
SELECT x.node, x.hops, (SELECT min(y.node) FROM best y JOIN l ON l.a = y.node WHERE l.b = x.node AND y.hops = x.hops - 1) AS parent FROM best x""",
    "override_edges": f"""WITH {CUR}, {_KEYS}, inh AS (SELECT DISTINCT id AS base, src AS child FROM ({_linked("'extends'", 'id', 'src')})), {_CONT}, holds AS (SELECT child AS member, parent AS holder FROM cont),
own AS (SELECT h.holder, h.member, n.name FROM holds h JOIN cur n ON n.id = h.member WHERE n.kind = 'method')
SELECT DISTINCT b.member AS base_method, c.member AS override, b.name AS method FROM inh JOIN own b ON b.holder = inh.base JOIN own c ON c.holder = inh.child AND c.name = b.name""",
    "top_level_contains": f"""WITH {CUR}, {_CONT}
SELECT f.id AS file_id, n.id FROM cur n JOIN cur f ON f.kind = 'file' AND f.file_path = n.file_path WHERE n.kind <> 'file' AND n.id NOT IN (SELECT child FROM cont)""",
    "local_target_resolution": f"""WITH {CUR}, q AS (SELECT qualified_name, file_path, min(id) AS q_id FROM cur GROUP BY ALL), m AS (SELECT name, file_path, min(id) AS m_id FROM cur GROUP BY ALL HAVING count(*) = 1)
SELECT e.edge_seq, coalesce(q_id, m_id) AS target_id FROM edges e JOIN cur s ON s.id = e.source LEFT JOIN q ON q.qualified_name = e.target AND q.file_path = s.file_path
LEFT JOIN m ON m.name = e.target AND m.file_path = s.file_path WHERE coalesce(q_id, m_id) IS NOT NULL""",
    "unresolved_groups": "SELECT reference_name, reference_kind, file_path, language, count(*) AS n FROM unresolved_refs WHERE resolution_status IS NULL GROUP BY ALL",
    "unresolved_groups_top": """SELECT reference_name, reference_kind, file_path, language, count(*) AS n FROM unresolved_refs WHERE resolution_status IS NULL
GROUP BY ALL ORDER BY n DESC, reference_name, reference_kind, file_path, language LIMIT 100""",
    "trackable_refs": f"""WITH {_FLAG} SELECT ref_seq, is_builtin, reference_name <> '' AND NOT is_builtin AND NOT (language = 'shell' AND starts_with(trim(reference_name), '$'))
AND NOT (language IN ({_C}) AND reference_kind IN ('calls', 'references', 'instantiates') AND (length({_BARE}) <= 1 OR ends_with({_BARE}, '_MACRO') OR regexp_matches({_BARE}, '^_[_A-Z0-9]*$')
OR (regexp_matches({_BARE}, '[A-Z]') AND NOT regexp_matches({_BARE}, '[a-z]')))) AS is_trackable FROM flag""",
    "possible_names": f"WITH {CUR}, {_PIECES} SELECT reference_name FROM possible",
    "imported_files": f"WITH RECURSIVE {CUR}, {CURF}, {_IMPORTS} SELECT file_path, target_path FROM imported",
    "include_closure": f"WITH RECURSIVE {CUR}, {CURF}, {_IMPORTS} SELECT file_path, target_path, min(depth) AS depth FROM closure GROUP BY ALL",
    "resolve_groups": f"WITH RECURSIVE {_RESOLVED} SELECT * FROM out",
    "resolve_totals": f"WITH RECURSIVE {_RESOLVED} SELECT coalesce(rule, reason) AS outcome, count(*) AS n_groups, sum(n)::BIGINT AS n_refs FROM out GROUP BY 1",
    "resolve_edges": f"""WITH RECURSIVE {_RESOLVED} SELECT e.edge_seq, e.source, coalesce(o.node_id, e.target) AS target, e.kind,
CASE WHEN o.node_id IS NOT NULL THEN 'tree-sitter+resolved-cross-file' ELSE e.provenance END AS provenance
FROM edges e LEFT JOIN cur s ON s.id = e.source LEFT JOIN out o ON o.node_id IS NOT NULL AND o.reference_name = e.target AND o.reference_kind = e.kind AND o.file_path = s.file_path""",
}
