"""Queries behind contexts and exploration, point lookups and small sinks, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import columns as C
from sylvan.functions import kinds as K
from sylvan.functions.terms import explore_terms
from sylvan.operators import context, hybrid, resolve, search, sync, text_search
from sylvan.plans.relations import _BUILTIN, _C, _PREFIX, edges
from sylvan.plans.symbols import CUR, CURF, TEST_SQL, files, nodes
from sylvan.plans.texts import _ARMS, _HITS, _LOW, _ONE, _TOK, T, TASK, contents
from sylvan.staging import Staging
from sylvan.tables import read

EXPLORED = "merge queue lock"
SPARSE = "zebra relay_queue"
SHOWN = 64
BUDGET = 20_000


def roots(s: SparkSession, d: str) -> DataFrame:
    """The symbols a task names, each with a score of 100 more than the weight of its kind."""
    named = nodes(s, d).filter(F.col("name").isin(*T.symbols))
    return named.select("id", "name", "file_path", "start_line", (F.lit(100.0) + K.lookup(K.WEIGHT, F.col("kind"), 0)).alias("score"), F.lit(True).alias("is_root"))


def staged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    st = Staging(s, "roots")
    return st.put(nodes(s, d).select(*context.SHOWN, "start_column"), "nodes"), st.put(roots(s, d), "roots")


def expansion(s: SparkSession, d: str) -> DataFrame:
    n, some = staged(s, d)
    return context.expansion(some, n, edges(s, d), T)


def related(s: SparkSession, d: str) -> DataFrame:
    n, some = staged(s, d)
    return context.relationship_context(some, n, edges(s, d), T)


def low_information(s: SparkSession, d: str) -> DataFrame:
    return context.with_low_information(nodes(s, d), T.terms).select("id", "low_information")


def explored(s: SparkSession, d: str, query: str = EXPLORED) -> DataFrame:
    return context.explore_nodes(nodes(s, d), read(s, d, "file_contents"), query, SHOWN)


def kept_edges(s: SparkSession, d: str) -> DataFrame:
    some = Staging(s, "kept").put(explored(s, d), "some")
    return context.edges_between(some, edges(s, d))


def relations(s: SparkSession, d: str) -> DataFrame:
    some = Staging(s, "kept").put(explored(s, d), "some")
    return context.explore_relations(some, edges(s, d))


def promoted(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    found = hybrid._promoted(n.filter(F.col("kind").isin("variable", "field", "property", "constant")), n)
    return found.select(F.col("leaf").alias("id"), F.col("outer.id").alias("outer_id"))


def node_texts(s: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "name", "qualified_name", F.coalesce("docstring", F.lit("")), F.coalesce("signature", F.lit("")))
    return text_search.bm25(nodes(s, d).select("id", text.alias("text")), "id", "text", ["lock", "queue", "drained"]).select("id", F.round("score", 6).alias("score"))


def edges_of_nodes(s: SparkSession, d: str) -> DataFrame:
    from sylvan.operators.graph import edges_for_nodes

    return edges_for_nodes(nodes(s, d), edges(s, d))


def budgeted(s: SparkSession, d: str) -> DataFrame:
    """Files of each repository, small ones first, while their sizes stay within a budget."""
    some = files(s, d).select("path", "size", F.regexp_extract("path", r"^([^/\\]+)", 1).alias("repo"))
    return context.within_budget(some, "size", ["size", "path"], BUDGET, ["repo"]).select("path", "used")


def upserted(s: SparkSession, d: str) -> DataFrame:
    """Project metadata after two keys are written and one is deleted."""
    from sylvan.tables import latest

    now = latest(read(s, d, "project_metadata"), "key", "updated_at")
    fresh = now.orderBy("key").limit(1).select("key", F.lit("rewritten").alias("value"), (F.col("updated_at") + 1).alias("updated_at"))
    fresh = fresh.unionByName(s.createDataFrame([("added_key", "added", 1)], "key string, value string, updated_at bigint"))
    gone = now.orderBy(F.desc("key")).limit(1).select("key")
    return sync.replace_rows(now, fresh, "key").join(gone, "key", "left_anti").select("key", "value")


def editor_kinds(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).select("id", K.lookup(K.CODE_BLOCK_PRIORITY, F.col("kind"), 1).alias("code_block"), K.lookup(K.ENTRY_PRIORITY, F.col("kind"), 1).alias("entry"), K.lookup(K.EDITOR_KIND, F.col("kind"), 13).alias("editor_kind"))


def uris(s: SparkSession, d: str) -> DataFrame:
    uri = C.file_uri(F.concat(F.lit("/src tree/"), "path"))
    return files(s, d).select("path", uri.alias("uri"), C.uri_path(uri).alias("back"))


QUERIES = {
    "neighbour_expansion": expansion,
    "relationship_context": related,
    "low_information": low_information,
    "explore_nodes": lambda s, d: explored(s, d).select("id", "name", "file_path"),
    "explore_sparse": lambda s, d: explored(s, d, SPARSE).select("id", "name", "file_path"),
    "explore_relations": relations,
    "kept_edges": kept_edges,
    "leaf_promotion": promoted,
    "node_text_search": node_texts,
    "edges_for_nodes": edges_of_nodes,
    "edges_of_kind": lambda s, d: edges(s, d).filter(F.col("kind") == "implements").select("edge_seq", "source", "target"),
    "nodes_of_kind": lambda s, d: nodes(s, d).filter(F.col("kind") == "struct").select("id", "name"),
    "refs_of_file": lambda s, d: resolve.pending_of(read(s, d, "unresolved_refs"), files(s, d).orderBy("path").limit(20).select("path")).select("ref_seq"),
    "output_budget": budgeted,
    "metadata_upsert": upserted,
    "editor_kinds": editor_kinds,
    "path_uris": uris,
    "context_nodes": lambda s, d: context.context_nodes(nodes(s, d), edges(s, d), read(s, d, "file_contents"), TASK).select("id", "name", "file_path", "score", "is_root"),
}

_HAY_OF = "lower(concat_ws(' ', {0}.name, {0}.qualified_name, {0}.file_path, coalesce({0}.signature, '')))"
_OVER = lambda a: "(" + " + ".join(f"contains({_HAY_OF.format(a)}, '{t}')::INT" for t in T.terms) + ")"
_KEYS = "keys AS (SELECT id AS key, id, name FROM cur UNION SELECT name, id, name FROM cur)"
_ROOTS = f"""roots AS (SELECT id, name, file_path, start_line, 100.0 + {K.case_sql(K.WEIGHT, 'kind', 0)} AS score FROM cur WHERE name IN ({', '.join(f"'{x}'" for x in T.symbols)}))"""


def _side(some: str, kinds: str, side: str, limit: int) -> str:
    if side == "in":
        body = f"""SELECT r.id AS of, e.source AS id, e.line, e.col FROM edges e JOIN (SELECT id AS key, id FROM {some} UNION SELECT name, id FROM {some}) r ON r.key = e.target
WHERE e.kind IN ({kinds}) AND e.source IN (SELECT id FROM cur)"""
    else:
        body = f"SELECT r.id AS of, k.id, e.line, e.col FROM edges e JOIN (SELECT DISTINCT id FROM {some}) r ON r.id = e.source JOIN keys k ON k.key = e.target WHERE e.kind IN ({kinds})"
    return f"""(SELECT of, id FROM (SELECT of, id, min((coalesce(line, 0), coalesce(col, 0))) AS spot FROM ({body}) GROUP BY of, id)
QUALIFY row_number() OVER (PARTITION BY of ORDER BY spot, id) <= {limit})"""


_REFS = "'references', 'imports', 'instantiates'"
_INFRA = f"regexp_matches(lower({{0}}.name), '{C.INFRASTRUCTURE}')"
_RUNTIME = ", ".join(f"'{n}'" for n in context.RUNTIME_NAMES)


def _dull(a: str) -> str:
    builtin = f"({a}.name IN (SELECT name FROM builtin b WHERE b.language = {a}.language) OR ({a}.language IN ({_C}) AND ({_PREFIX.replace('r.reference_name', a + '.name').replace('reference_name', a + '.name')})))"
    header = f"((contains(lower({a}.file_path), '/hdr/') OR ends_with(lower({a}.file_path), '.h')) AND {a}.kind IN ('function', 'variable', 'constant', 'field'))"
    return f"({_OVER(a)} = 0 AND coalesce({builtin} OR {a}.name IN ({_RUNTIME}) OR {_INFRA.format(a)} OR {header}, false))"


def _explored(query: str) -> str:
    arms = []
    for i, p in enumerate([query, *[w for w in explore_terms(query) if len(w) > 1]]):
        arms.append(
            f"(SELECT id, {i} AS arm, row_number() OVER (ORDER BY CASE WHEN name = '{p}' THEN 0 ELSE 1 END, length(name), file_path, start_line, id) AS nth FROM cur WHERE name ILIKE '{p}%' QUALIFY nth <= {SHOWN})"
        )
    words = [w for w in explore_terms(query) if len(w) > 1]
    hits = " + ".join(f"least(5, len(string_split(lower(coalesce(content, '')), '{w}')) - 1)" for w in words)
    return f"""{CUR}, {_ONE}, x_named AS ({' UNION ALL '.join(arms)}), x_few AS (SELECT count(DISTINCT id) < {min(SHOWN, 8)} AS few FROM x_named),
x_files AS (SELECT path, {hits} AS hits FROM one WHERE path IS NOT NULL AND ({hits}) > 0 ORDER BY hits DESC, path LIMIT 8),
x_near AS (SELECT n.id, f.hits, f.path, row_number() OVER (PARTITION BY n.file_path ORDER BY n.start_line, n.end_line DESC, n.id) AS k FROM cur n JOIN x_files f ON f.path = n.file_path QUALIFY k <= 12),
x_more AS (SELECT id, {len(words) + 1} AS arm, row_number() OVER (ORDER BY hits DESC, path, k) AS nth FROM x_near WHERE (SELECT few FROM x_few)),
x_first AS (SELECT id, min((arm, nth)) AS place FROM (SELECT * FROM x_named UNION ALL SELECT * FROM x_more) GROUP BY id ORDER BY place, id LIMIT {SHOWN}),
chosen AS (SELECT c.* FROM cur c JOIN x_first x ON x.id = c.id)"""


_NODE_TEXT = "(SELECT id, concat_ws(' ', name, qualified_name, coalesce(docstring, ''), coalesce(signature, '')) AS text FROM cur)"
_BM = ["drained", "lock", "queue"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(_BM))
_DF = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(_BM)))
_SC = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END" for i in range(len(_BM)))

SQL = {
    "neighbour_expansion": f"""WITH {CUR}, {_KEYS}, {_ROOTS}, found AS (SELECT *, 'caller' AS reason FROM {_side('roots', "'calls'", 'in', 5)} UNION ALL SELECT *, 'callee' FROM {_side('roots', "'calls'", 'out', 5)}
UNION ALL SELECT *, 'reference' FROM {_side('roots', _REFS, 'in', 3)}),
scored AS (SELECT f.id, f.reason, round((r.score * 0.72 + CASE WHEN f.id IN (SELECT id FROM roots) THEN 25.0 ELSE 0.0 END + {K.case_sql(K.WEIGHT, 'n.kind', 0)}) * CASE WHEN {TEST_SQL.format('n.file_path')} THEN 0.35 ELSE 1.0 END, 6)::DOUBLE AS score
FROM found f JOIN roots r ON r.id = f.of JOIN cur n ON n.id = f.id)
SELECT id, max(score) AS score, arg_max(reason, (score, reason)) AS reason FROM scored GROUP BY id""",
    "relationship_context": f"""WITH {CUR}, {_KEYS}, {_ROOTS}, builtin AS ({_BUILTIN}), first AS (SELECT * FROM roots ORDER BY score DESC, start_line, id LIMIT 12),
pairs AS (SELECT *, 'callee' AS label FROM {_side('first', "'calls'", 'out', 80)} UNION ALL SELECT *, 'caller' FROM {_side('first', "'calls'", 'in', 40)}),
wide AS (SELECT p.of, p.label, n.* FROM pairs p JOIN cur n ON n.id = p.id WHERE p.id NOT IN (SELECT id FROM roots) AND n.kind NOT IN ({_LOW}, 'file') AND NOT {_dull('n')}),
fan AS (SELECT of AS id, count(*) AS fan_in FROM {_side('wide', "'calls'", 'in', 25)} GROUP BY of),
scored AS (SELECT w.id, w.label || ' of ' || f.name AS reason, round(f.score * 0.58 + {K.case_sql(K.WEIGHT, 'w.kind', 0)} + {K.case_sql(K.IMPLEMENTATION_BIAS, 'w.kind', 0)} + {_OVER('w')} * 20.0 + CASE WHEN w.file_path = f.file_path THEN 8.0 ELSE 0.0 END
- CASE WHEN {_OVER('w')} > 0 OR w.file_path = f.file_path THEN 0.0 ELSE CASE WHEN {_INFRA.format('w')} THEN 90.0 ELSE 0.0 END + CASE WHEN fan_in >= 20 THEN 55.0 WHEN fan_in >= 10 THEN 25.0 ELSE 0.0 END END, 6)::DOUBLE AS score
FROM wide w JOIN first f ON f.id = w.of LEFT JOIN fan ON fan.id = w.id)
SELECT id, max(score) AS score, arg_max(reason, (score, reason)) AS reason FROM scored WHERE score > 0 GROUP BY id""",
    "low_information": f"WITH {CUR}, builtin AS ({_BUILTIN}) SELECT id, {_dull('cur')} AS low_information FROM cur",
    "explore_nodes": f"WITH {_explored(EXPLORED)} SELECT id, name, file_path FROM chosen",
    "explore_sparse": f"WITH {_explored(SPARSE)} SELECT id, name, file_path FROM chosen",
    "explore_relations": f"""WITH {_explored(EXPLORED)}, named AS (SELECT key, min(name) AS name FROM (SELECT id AS key, name FROM chosen UNION SELECT name, name FROM chosen) GROUP BY key)
SELECT DISTINCT a.name AS source, b.name AS target, e.kind FROM edges e JOIN named a ON a.key = e.source JOIN named b ON b.key = e.target WHERE e.kind IN ('calls', 'references')""",
    "kept_edges": f"""WITH {_explored(EXPLORED)}, k AS (SELECT key, min(id) AS id FROM (SELECT id AS key, id FROM chosen UNION SELECT name, id FROM chosen) GROUP BY key)
SELECT a.id AS source_id, b.id AS target_id, e.kind, min(e.line) AS line FROM edges e JOIN k a ON a.key = e.source JOIN k b ON b.key = e.target
WHERE e.kind IN ('calls', 'references', 'extends', 'implements', 'overrides') GROUP BY ALL""",
    "leaf_promotion": f"""WITH {CUR} SELECT l.id, o.id AS outer_id FROM cur l JOIN cur o ON o.file_path = l.file_path AND o.kind IN ('function', 'method', 'class', 'struct', 'interface', 'trait')
AND o.start_line <= l.start_line AND greatest(o.end_line, o.start_line) >= l.start_line AND o.id <> l.id WHERE l.kind IN ('variable', 'field', 'property', 'constant')
QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY greatest(o.end_line - o.start_line, 0), o.start_line, o.start_column, o.end_line DESC, o.id) = 1""",
    "node_text_search": f"""WITH {CUR}, t AS (SELECT id, {_TOK.format('text')} AS w FROM {_NODE_TEXT}), c AS (SELECT id, len(w) AS length, {_TF} FROM t), f AS (SELECT count(*) AS n, avg(length) AS mean, {_DF} FROM c)
SELECT id, round({_SC}, 6) AS score FROM c, f WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0""",
    "edges_for_nodes": f"""WITH {CUR}, by_id AS (SELECT c.id, e.edge_seq FROM cur c JOIN edges e ON e.source = c.id UNION SELECT c.id, e.edge_seq FROM cur c JOIN edges e ON e.target = c.id),
rest AS (SELECT id, name FROM cur WHERE id NOT IN (SELECT id FROM by_id)),
by_name AS (SELECT r.id, e.edge_seq FROM rest r JOIN edges e ON e.source = r.name UNION SELECT r.id, e.edge_seq FROM rest r JOIN edges e ON e.target = r.name)
SELECT id, edge_seq, 'id' AS found_by FROM by_id UNION ALL SELECT id, edge_seq, 'name' FROM by_name""",
    "edges_of_kind": "SELECT edge_seq, source, target FROM edges WHERE kind = 'implements'",
    "nodes_of_kind": f"WITH {CUR} SELECT id, name FROM cur WHERE kind = 'struct'",
    "refs_of_file": f"WITH {CURF} SELECT ref_seq FROM unresolved_refs WHERE resolution_status IS NULL AND file_path IN (SELECT path FROM curf ORDER BY path LIMIT 20)",
    "output_budget": rf"""WITH {CURF}, r AS (SELECT path, size, regexp_extract(path, '^([^/\\]+)', 1) AS repo FROM curf)
SELECT path, (sum(size) OVER (PARTITION BY repo ORDER BY size, path ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM r QUALIFY used <= {BUDGET}""",
    "metadata_upsert": """WITH now AS (SELECT key, arg_max(value, (updated_at, value)) AS value FROM project_metadata WHERE key IS NOT NULL GROUP BY key)
SELECT key, CASE WHEN key = (SELECT min(key) FROM now) THEN 'rewritten' ELSE value END AS value FROM now WHERE key <> (SELECT max(key) FROM now) UNION ALL SELECT 'added_key', 'added'""",
    "editor_kinds": f"WITH {CUR} SELECT id, {K.case_sql(K.CODE_BLOCK_PRIORITY, 'kind', 1)} AS code_block, {K.case_sql(K.ENTRY_PRIORITY, 'kind', 1)} AS entry, {K.case_sql(K.EDITOR_KIND, 'kind', 13)} AS editor_kind FROM cur",
    "path_uris": rf"WITH {CURF}, p AS (SELECT path, '/src tree/' || path AS whole FROM curf) SELECT path, 'file://' || replace(url_encode(whole), '%2F', '/') AS uri, whole AS back FROM p",
}
