"""Edges between symbols: callers, callees, references, reach and paths.

An edge's target is a node id, a qualified name or a bare name. Each use of "id or name" is written as
one equality join over an exploded key, since OR in a join condition would compare all with all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.operators.hierarchy import contains_links
from sylvan.staging import Staging

REFERENCE_KINDS = ("references", "imports", "instantiates")


def by_id_or_name(nodes: DataFrame) -> DataFrame:
    """(key, id, name): every node under its id and under its name, once each."""
    keys = F.array_distinct(F.array("id", "name"))
    return nodes.select(F.explode(keys).alias("key"), "id", "name").filter(F.col("key").isNotNull())


def linked(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(target_id, source_id, line, col) of edges of some kinds whose target names a node by id or name and
    whose source is a node; one row per pair and call site however often the edge was delivered."""
    some = edges.filter(F.col("kind").isin(*kinds)).select("source", "target", "line", "col").distinct()
    sources = nodes.select(F.col("id").alias("source_id"))
    return (
        some.join(by_id_or_name(nodes), F.col("target") == F.col("key"))
        .join(sources, F.col("source") == F.col("source_id"))
        .select(F.col("id").alias("target_id"), "source_id", "line", "col")
        .distinct()
    )


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return linked(nodes, edges, ("calls",)).select(F.col("target_id").alias("id"), F.col("source_id").alias("caller_id"), "line", "col")


def references_to(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return linked(nodes, edges, REFERENCE_KINDS).select(F.col("target_id").alias("id"), F.col("source_id").alias("referrer_id"), "line", "col")


def callees(nodes: DataFrame, edges: DataFrame, by_name: bool = False) -> DataFrame:
    """(id, callee_id) of calls; with ``by_name`` calls of every node that has the same name count too."""
    if by_name:
        return _callees_by_name(nodes, edges)
    return linked(nodes, edges, ("calls",)).select(F.col("source_id").alias("id"), F.col("target_id").alias("callee_id")).distinct()


def _callees_by_name(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each pair comes up once by construction, since the pairs are far more than the edges and no shuffle should hold them:
    calls are reduced to (name, target), a callee found by id is left out where the same name calls it by name too, and an
    id, which has one name (``nodes`` are current rows), meets the callees of that name in the last join."""
    known = nodes.select("id", "name").distinct()  # no work on current rows, which are grouped by id
    callers = known.filter(F.col("name").isNotNull())
    calls = edges.filter(F.col("kind") == "calls").select("source", "target")
    calls = calls.join(callers.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").select("caller", "target").distinct()
    found = known.select(F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    by_id = calls.join(found, F.col("target") == F.col("callee_id")).select("caller", "callee_id", "callee")
    by_id = by_id.join(calls.withColumnRenamed("target", "callee"), ["caller", "callee"], "left_anti")
    named = calls.join(found, F.col("target") == F.col("callee"))
    called = named.select("caller", "callee_id").unionByName(by_id.select("caller", "callee_id"))
    return called.join(callers, F.col("caller") == F.col("name")).select("id", "callee_id")


def edges_for_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, edge_seq, found_by): edges at either end of each node by id; of a node without any, those by its name."""
    ends = edges.select("edge_seq", F.explode(F.array_distinct(F.array("source", "target"))).alias("end")).filter(F.col("end").isNotNull())
    by_id = nodes.select("id").join(ends, F.col("id") == F.col("end")).select("id", "edge_seq")
    bare = nodes.select("id", "name").join(ends, F.col("id") == F.col("end"), "left_anti")
    by_name = bare.join(ends, F.col("name") == F.col("end")).select("id", "edge_seq")
    return by_id.withColumn("found_by", F.lit("id")).unionByName(by_name.withColumn("found_by", F.lit("name")))


def uncalled_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that no call names, neither by id nor by name."""
    called = edges.filter((F.col("kind") == "calls") & F.col("target").isNotNull()).select("target").distinct()
    rest = nodes.filter(F.col("kind") == "function")
    rest = rest.join(called, F.col("id") == F.col("target"), "left_anti")
    return rest.join(called, F.col("name") == F.col("target"), "left_anti").select("id", "name", "file_path", "start_line")


def degree(edges: DataFrame, end: str, kind: str = "calls", limit: int = 20) -> DataFrame:
    """Ends of most edges of a kind, deliveries of one link counted once."""
    return (
        edges.filter((F.col("kind") == kind) & F.col(end).isNotNull())
        .select("source", "target", "line", "col")
        .distinct()
        .groupBy(F.col(end).alias("key"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "key")
        .limit(limit)
    )


def call_graph(nodes: DataFrame, edges: DataFrame, ids: DataFrame, per_node: int = 100) -> DataFrame:
    """Calls out of a set of nodes, at most ``per_node`` callees each."""
    out = callees(nodes, edges).join(ids.select("id").distinct(), "id", "left_semi")
    rank = F.row_number().over(W.partitionBy("id").orderBy("callee_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= per_node).select("id", "callee_id")


def bfs(edges: DataFrame, start: DataFrame, kind: str | None = "calls", direction: str = "out", max_depth: int = 3) -> DataFrame:
    """(node, depth) reached level by level from ``start`` (column node) along exact ids.

    Each level is one join of the frontier with the distinct links and one anti-join with what was seen,
    written to the shared folder; the walk ends when a level is empty."""
    st = Staging(edges.sparkSession, "bfs")
    some = edges if kind is None else edges.filter(F.col("kind") == kind)
    pairs = [("source", "target")] if direction == "out" else [("target", "source")] if direction == "in" else [("source", "target"), ("target", "source")]
    links = None
    for a, b in pairs:
        part = some.select(F.col(a).alias("a"), F.col(b).alias("b"))
        links = part if links is None else links.unionByName(part)
    links = st.put(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "links")
    frontier = seen = st.put(start.select("node").distinct().withColumn("depth", F.lit(0)), "level-0")
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        fresh = st.put(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), f"level-{depth}")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen


def impact_radius(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth) of everything that calls the start nodes, directly or in up to ``depth`` steps, calls by
    name included."""
    calls = linked(nodes, edges, ("calls",)).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    known = nodes.select(F.col("id").alias("node"))
    return bfs(calls, start.join(known, "node", "left_semi"), None, "in", depth)


def shortest_paths(edges: DataFrame, start: DataFrame, max_hops: int = 33) -> DataFrame:
    """(node, hops, parent) of the shortest walk along calls from the start nodes; parent is the smallest id
    from which the node is first reached, so paths can be read back deterministically."""
    st = Staging(edges.sparkSession, "paths")
    links = edges.filter((F.col("kind") == "calls") & F.col("source").isNotNull() & F.col("target").isNotNull())
    links = st.put(links.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "links")
    frontier = seen = st.put(start.select("node").distinct().select("node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")), "level-0")
    for hops in range(1, max_hops + 1):
        step = frontier.join(links, F.col("node") == F.col("a")).groupBy("b").agg(F.min("a").alias("parent"))
        step = step.select(F.col("b").alias("node"), F.lit(hops).alias("hops"), "parent")
        fresh = st.put(step.join(seen, "node", "left_anti"), f"level-{hops}")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen


def override_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """base method -> overriding method, where a class extends another one of the same file set by id or name
    and both contain a method of one name."""
    inherits = linked(nodes, edges, ("extends",)).select(F.col("source_id").alias("child_class"), F.col("target_id").alias("base_class")).distinct()
    holds = contains_links(nodes, edges).select(F.col("parent").alias("holder"), F.col("child").alias("member"))
    methods = nodes.filter(F.col("kind") == "method").select(F.col("id").alias("member"), F.col("name").alias("method"))
    own = holds.join(methods, "member")
    base = own.select(F.col("holder").alias("base_class"), "method", F.col("member").alias("base_method"))
    child = own.select(F.col("holder").alias("child_class"), "method", F.col("member").alias("override"))
    return inherits.join(base, "base_class").join(child, ["child_class", "method"]).select("base_method", "override", "method").distinct()


def top_level(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, id): symbols that nothing in their file contains belong to the file's own node."""
    inner = contains_links(nodes, edges).select(F.col("child").alias("id"))
    files = nodes.filter(F.col("kind") == "file").select(F.col("id").alias("file_id"), "file_path")
    free = nodes.filter(F.col("kind") != "file").join(inner, "id", "left_anti")
    return free.join(files, "file_path").select("file_id", "id")
