"""Queries of the general data problems: hierarchies and uneven keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators.dense_agg import dense_key_stats
from sylvan.operators.hierarchy import ancestor_pairs, contains_links, descendants_of, hierarchy
from sylvan.session import spread
from sylvan.staging import Staging
from sylvan.tables import latest, read

DEEP = 6


def _tree(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    nodes, edges = read(spark, d, "nodes"), read(spark, d, "edges")
    members = latest(nodes.select("id", "name", "updated_at"), "id", "updated_at").select(
        F.col("id").alias("node"), F.col("name").alias("label")
    )
    return hierarchy(contains_links(nodes, edges), members, paths=paths)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d, paths=False)
    return tree.filter((F.col("depth") >= DEEP) | (F.col("depth") == -1)).select(
        F.col("node").alias("node_id"), F.coalesce("root", "cycle_id").alias("top_id"), F.col("depth").cast("int").alias("depth")
    )


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, paths=True).select(
        F.col("node").alias("node_id"),
        F.col("parent").alias("parent_id"),
        "status",
        F.coalesce("root", "cycle_id").alias("top_id"),
        "depth",
        "subtree_size",
        "path",
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return ancestor_pairs(_tree(spark, d, paths=True)).select(
        F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), F.col("distance").cast("int").alias("distance")
    )


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The compact form of all descendants: those of a node are the rows of its tree with ``pre`` in (pre, last]."""
    tree = _tree(spark, d, paths=False).filter(F.col("status") == "tree")
    return tree.select(F.col("node").alias("node_id"), F.col("root").alias("top_id"), "pre", "last", F.col("chain").alias("chain_id"), "chain_pos")


def p1_subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants of each node that has some, counted over its interval."""
    tree = Staging(spark, "tree").put(_tree(spark, d, paths=False), "tree")
    found = descendants_of(tree, tree.select("node"), 64)
    return found.groupBy(F.col("ancestor").alias("node_id")).agg(F.count("*").alias("n_descendants"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges")
    stats = dense_key_stats(spread(edges.select("target", "kind", "line")), ["target", "kind"], None, "line")
    total = edges.agg(F.count("*").alias("total"))
    return stats.crossJoin(F.broadcast(total)).filter(F.col("n_rows") * 100 >= F.col("total")).select("target", "kind")


def p5_key_stats(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges")
    return dense_key_stats(spread(edges.select("target", "kind", "source", "line")), ["target", "kind"], "source", "line")


QUERIES = {
    "p1_found": p1_found,
    "p1_hierarchy": p1_hierarchy,
    "p1_descendants": p1_descendants,
    "p1_intervals": p1_intervals,
    "p1_subtree_sizes": p1_subtree_sizes,
    "p5_found": p5_found,
    "p5_key_stats": p5_key_stats,
}

_LINKS = """cur AS (
  SELECT id, arg_max(qualified_name, updated_at) AS qualified_name, arg_max(name, updated_at) AS name FROM nodes WHERE id IS NOT NULL GROUP BY id),
links AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT coalesce(a.id, b.id) AS child, e.source AS parent
    FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains') e
    JOIN cur s ON s.id = e.source
    LEFT JOIN cur a ON a.id = e.target
    LEFT JOIN cur b ON b.qualified_name = e.target) x
  WHERE child IS NOT NULL GROUP BY child),
tree(node, top, depth, path) AS (
  SELECT c.id, c.id, 0, c.name FROM cur c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.child = c.id)
  UNION ALL
  SELECT l.child, t.top, t.depth + 1, t.path || '/' || c.name FROM tree t JOIN links l ON l.parent = t.node JOIN cur c ON c.id = l.child),
lost AS (SELECT c.id AS node FROM cur c WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.node = c.id)),
walk(node, seen) AS (
  SELECT l.child, l.parent FROM links l JOIN lost x ON x.node = l.child
  UNION
  SELECT w.node, l.parent FROM walk w JOIN links l ON l.child = w.seen),
ring AS (SELECT node FROM walk WHERE node = seen),
low AS (SELECT w.node, min(w.seen) AS cycle_id FROM walk w JOIN ring r ON r.node = w.seen GROUP BY w.node)"""

_UP = """anc(node, ancestor, distance) AS (
  SELECT child, parent, 1 FROM links l JOIN tree t ON t.node = l.child
  UNION ALL
  SELECT a.node, l.parent, a.distance + 1 FROM anc a JOIN links l ON l.child = a.ancestor)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_LINKS}
SELECT node AS node_id, top AS top_id, depth FROM tree WHERE depth >= {DEEP}
UNION ALL SELECT node, cycle_id, -1 FROM low""",
    "p1_hierarchy": f"""WITH RECURSIVE {_LINKS}, {_UP},
size AS (SELECT ancestor AS node, count(*) AS n FROM anc GROUP BY ancestor)
SELECT t.node AS node_id, l.parent AS parent_id, 'tree' AS status, t.top AS top_id, t.depth, coalesce(s.n, 0) + 1 AS subtree_size, t.path
FROM tree t LEFT JOIN links l ON l.child = t.node LEFT JOIN size s ON s.node = t.node
UNION ALL
SELECT w.node, l.parent, CASE WHEN r.node IS NULL THEN 'below_cycle' ELSE 'cycle' END, w.cycle_id, -1, NULL, NULL
FROM low w JOIN links l ON l.child = w.node LEFT JOIN ring r ON r.node = w.node""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}, {_UP}
SELECT ancestor AS ancestor_id, node AS node_id, distance FROM anc""",
    "p1_subtree_sizes": f"""WITH RECURSIVE {_LINKS}, {_UP}
SELECT ancestor AS node_id, count(*) AS n_descendants FROM anc GROUP BY ancestor""",
    "p5_found": """SELECT target, kind FROM edges GROUP BY target, kind HAVING count(*) * 100 >= (SELECT count(*) FROM edges)""",
    "p5_key_stats": """SELECT target, kind, count(*) AS n_rows, count(DISTINCT source) AS n_sources, min(line) AS first_line, max(line) AS last_line
FROM edges GROUP BY target, kind""",
}
