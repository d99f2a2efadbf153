"""Parent-child links to full hierarchies.

Heavy-path decomposition over rows that may hold trees of any depth, and cycles:

1. *Cycle separation and subtree sizes* by pointer doubling: after k rounds every node knows its
   ancestor 2^k steps up and the number of its descendants nearer than 2^k. ``log2(depth)`` rounds;
   nodes still without a root when a round closes nobody are on or below a cycle.
2. *Chains*: the child with the largest subtree is its parent's heavy child; heavy links form chains,
   whose heads and positions come from pointer doubling along heavy links only.
3. *Chain tree*: at most ``log2(n)`` chains lie above any node. Depth, preorder and path of a node are
   those of its chain's head plus its own segment, so they are concatenated chain by chain.

In preorder (heavy child first) every chain and every subtree is one interval, so the descendants of
a node are the rows of its root with ``pre`` between ``pre`` and ``last``.

Every round is a shuffle join whose right side is unique on the key; a parent with very many children
makes only the left side uneven, which AQE splits. Siblings are numbered by salted two-level sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sylvan.staging import Staging
from sylvan.tables import latest

SIBLING_BITS = 10


def contains_links(nodes: DataFrame, edges: DataFrame, kind: str = "contains") -> DataFrame:
    """(child, parent) from the rows of one kind whose source is a node id and whose target is the
    id, else the qualified name, of a node. Repeats count once. Null ends link nothing; should a child
    have several parents the smallest id is kept (the data promises one)."""
    current = latest(nodes.select("id", "qualified_name", "updated_at"), "id", "updated_at")
    key = F.explode(
        F.array(
            F.struct(F.col("id").alias("key"), F.lit(0).alias("rank"), F.col("id").alias("node")),
            F.struct(F.col("qualified_name").alias("key"), F.lit(1).alias("rank"), F.col("id").alias("node")),
        )
    )
    lookup = (
        current.select(key.alias("k"))
        .select("k.*")
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min(F.struct("rank", "node")).alias("hit"))
        .select("key", F.col("hit.node").alias("child"))
    )
    raw = edges.filter(F.col("kind") == kind).select("source", "target").distinct()
    return (
        raw.join(lookup, raw.target == lookup.key)
        .join(current.select(F.col("id").alias("parent")), F.col("source") == F.col("parent"), "left_semi")
        .groupBy("child")
        .agg(F.min("source").alias("parent"))
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _jump(
    st: Staging,
    start: DataFrame,
    carry: dict[str, Callable[[Column, Column], Column]],
    name: str,
    sizes: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Pointer doubling. ``start`` has node, ptr, hops (at a root itself and 0; a node that is its own
    parent has 1) and the carried columns.

    Returns the rows that found their root and those that never will (None if there are none). Only rows
    still on their way are written again in a round; their number comes from the write itself.
    A carried column is folded from the root side: combine(upper, lower). With ``sizes`` the column
    ``size`` grows to the number of nodes at or below each node: what a round adds to a node already at its
    root is set aside and summed at the end.
    """
    keep = [c for c in start.columns if c not in ("node", "ptr", "hops", *carry)]
    counts = {"left": F.sum((~F.col("closed")).cast("long")), "done": F.sum(F.col("closed").cast("long"))}
    folders: list[str] = []  # where rows at their root lie; one scan reads them all
    late, step = [], 0

    def advance(rows: DataFrame) -> tuple[DataFrame, int]:
        """Writes a round; the rows still on their way and their number."""
        rows = rows.withColumn("round", F.lit(step))
        table, seen = st.put_counted(rows, f"{name}-{step}", "closed", **counts)
        if seen["done"]:
            folders.append(f"{table._sylvan_path}/closed=true")
        return table.filter(~F.col("closed")), seen["left"]

    def at_root(columns: list[str]) -> DataFrame:
        kinds = StructType([f for f in table.schema if f.name != "closed"])
        rows = st.spark.read.schema(kinds).parquet(*folders) if folders else st.spark.createDataFrame([], kinds)
        return rows.withColumn("closed", F.lit(True)).select(*columns)

    table, left = advance(start.withColumn("closed", F.col("hops") == 0))
    while left:
        under_way = table
        columns = [c for c in table.columns if c != "round"]
        every = at_root(columns).unionByName(under_way.select(*columns))
        upper = every.select(
            F.col("node").alias("u_node"),
            F.col("ptr").alias("u_ptr"),
            F.col("hops").alias("u_hops"),
            F.col("closed").alias("u_closed"),
            *[F.col(c).alias(f"u_{c}") for c in carry],
        )
        moved = under_way.join(upper, F.col("ptr") == F.col("u_node")).select(
            "node",
            F.col("u_ptr").alias("ptr"),
            (F.col("hops") + F.col("u_hops")).alias("hops"),
            *[combine(F.col(f"u_{c}"), F.col(c)).alias(c) for c, combine in carry.items()],
            *keep,
            F.col("u_closed").alias("closed"),
        )
        if sizes:
            grown = (
                under_way.filter((F.col("hops") == 1 << step) & (F.col("ptr") != F.col("node")))
                .groupBy(F.col("ptr").alias("g_node"))
                .agg(F.sum("size").alias("more"))
            )
            late.append(grown.withColumn("g_round", F.lit(step)))
            moved = moved.join(grown, F.col("node") == F.col("g_node"), "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
            moved = moved.drop("g_node", "more")
        step += 1
        before, (table, left) = left, advance(moved)
        if left == before:
            break
    done = at_root(table.columns)
    if late:
        owed = _union(late).join(done.select("node", "round"), F.col("g_node") == F.col("node")).filter(F.col("g_round") >= F.col("round"))
        owed = owed.groupBy("g_node").agg(F.sum("more").alias("more"))
        done = done.join(owed, F.col("node") == F.col("g_node"), "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
        done = done.drop("g_node", "more")
    return done.drop("round", "closed"), table.drop("closed", "round") if left else None


def _cycles(st: Staging, stuck: DataFrame) -> DataFrame:
    """(node, parent, cycle_id, on_cycle) of nodes whose ancestors never end at a root.

    The image of the 2^k-step walk shrinks to exactly the nodes on cycles; the smallest id of a walk
    stops changing once it has gone round. Both are tested on counts, nothing is collected; the image, whose
    count is a job of its own, is looked at only from the round on in which no id changes."""
    table = st.put(stuck.select("node", "parent", F.col("parent").alias("ptr"), F.col("node").alias("low")), "cycle-0")
    image, step = -1, 0
    while True:
        up = table.select(F.col("node").alias("u_node"), F.col("ptr").alias("u_ptr"), F.col("low").alias("u_low"))
        step += 1
        after = table.join(up, F.col("ptr") == F.col("u_node")).select("node", "parent", F.col("u_ptr").alias("ptr"), F.least("low", "u_low").alias("low"), (F.col("u_low") < F.col("low")).alias("changed"))
        after, seen = st.put_counted(after, f"cycle-{step}", changed=F.sum(F.col("changed").cast("long")))
        st.drop(table)
        table = after.drop("changed")
        table._sylvan_path = after._sylvan_path
        # the image can only be whole once no smallest id changes any more
        if not seen["changed"]:
            size = table.agg(F.countDistinct("ptr").alias("n")).first()["n"]
            if size == image:
                break
            image = size
    on_cycle = table.select(F.col("ptr").alias("c_node")).distinct()
    low = table.join(on_cycle, F.col("node") == F.col("c_node"), "left_semi").select(
        F.col("node").alias("c_node"), F.col("low").alias("cycle_id")
    )
    return table.join(low, F.col("ptr") == F.col("c_node")).select("node", "parent", "cycle_id").join(
        on_cycle.select(F.col("c_node").alias("node"), F.lit(True).alias("on_cycle")), "node", "left"
    )


def hierarchy(
    links: DataFrame,
    members: DataFrame,
    *,
    paths: bool = True,
    separator: str = "/",
) -> DataFrame:
    """Full hierarchy of (child, parent) ``links`` over ``members`` (node, label).

    One row per member: node, parent, status (tree, cycle, below_cycle), root, depth, subtree_size,
    chain (head of its heavy chain), chain_pos, pre, last, and with ``paths`` also path (labels from
    the root joined by ``separator``) and route (array of chain and position, from the root's chain on).
    Members on or below a cycle have null root, depth -1, cycle_id = smallest id of the cycle, and no
    path. Links whose ends are no members, or null, are ignored; a null label counts as the node id; of a
    child with several parents the smallest is kept; empty tables give an empty result.
    """
    spark = members.sparkSession
    st = Staging(spark, "hierarchy")
    nodes = members.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("label").alias("label"))
    known = nodes.select(F.col("node").alias("parent"))
    up = links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent")).join(known, "parent", "left_semi")
    base = nodes.join(up, "node", "left")
    start = base.select(
        "node",
        F.coalesce("parent", "node").alias("ptr"),
        F.col("parent").isNotNull().cast("long").alias("hops"),
        "parent",
        F.coalesce("label", "node").alias("label"),
        F.lit(1).cast("long").alias("size"),
    )
    rooted, lost_rows = _jump(st, start, {}, "up", sizes=True)
    tree = st.put(rooted.select("node", "parent", "label", "size"), "sizes")

    heavy = tree.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(F.struct("size", "node")).alias("h"))
    heavy = st.put(heavy.select("parent", F.col("h.node").alias("h_node"), F.col("h.size").alias("h_size")), "heavy")
    marked = tree.join(heavy.select(F.col("h_node").alias("node"), F.lit(True).alias("is_heavy")), "node", "left")
    marked = marked.withColumn("is_heavy", F.coalesce("is_heavy", F.lit(False)))
    chain_start = marked.select(
        "node",
        F.when(F.col("is_heavy"), F.col("parent")).otherwise(F.col("node")).alias("ptr"),
        F.col("is_heavy").cast("long").alias("hops"),
        *([F.when(F.col("is_heavy"), F.concat(F.lit(separator), "label")).otherwise("").alias("seg")] if paths else []),
        "parent",
        "label",
        "size",
        "is_heavy",
    )
    join_up = {"seg": lambda u, x: F.concat(u, x)} if paths else {}
    inside, _ = _jump(st, chain_start, join_up, "chain")
    inside = inside.withColumnRenamed("ptr", "chain").withColumnRenamed("hops", "chain_pos")

    # Light siblings follow the heavy subtree in the order of a hash; sums by (parent, hash bucket)
    # come first, so that a parent with a third of all nodes is numbered in 2^SIBLING_BITS tasks.
    light = inside.filter(~F.col("is_heavy") & F.col("parent").isNotNull()).select(
        "node", "parent", "label", "size", F.xxhash64("node").alias("h")
    )
    light = light.withColumn("bucket", F.shiftright("h", 64 - SIBLING_BITS))
    sums = light.groupBy("parent", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(W.partitionBy("parent").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(heavy.select("parent", "h_size"), "parent")
    sums = sums.select("parent", "bucket", (F.col("before") + F.col("h_size") + 1).alias("lead"))
    within = F.sum("size").over(W.partitionBy("parent", "bucket").orderBy("h", "node").rowsBetween(W.unboundedPreceding, -1))
    heads = (
        light.withColumn("within", F.coalesce(within, F.lit(0)))
        .join(sums, ["parent", "bucket"])
        .select("node", "parent", "label", (F.col("lead") + F.col("within")).alias("offset"))
    )
    anchor = inside.select(
        F.col("node").alias("parent"),
        F.col("chain").alias("ptr"),
        F.col("chain_pos").alias("at"),
        *(["seg"] if paths else []),
    )
    hung = heads.join(anchor, "parent").select(
        "node",
        "ptr",
        F.lit(1).cast("long").alias("hops"),
        (F.col("at") + 1).alias("depth"),
        (F.col("at") + F.col("offset")).alias("pre"),
        *(
            [
                F.concat("seg", F.lit(separator), "label").alias("path"),
                F.array(F.struct(F.col("ptr").alias("chain"), F.col("at").alias("pos"))).alias("route"),
            ]
            if paths
            else []
        ),
    )
    tops = inside.filter(F.col("parent").isNull()).select(
        "node",
        F.col("node").alias("ptr"),
        F.lit(0).cast("long").alias("hops"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("pre"),
        *(
            [F.col("label").alias("path"), F.array().cast("array<struct<chain:string,pos:bigint>>").alias("route")]
            if paths
            else []
        ),
    )
    add, join = (lambda u, x: u + x), (lambda u, x: F.concat(u, x))
    folds = {"depth": add, "pre": add} | ({"path": join, "route": join} if paths else {})
    chains, _ = _jump(st, hung.unionByName(tops), folds, "tree")
    chains = chains.select(
        F.col("node").alias("chain"),
        F.col("ptr").alias("root"),
        F.col("depth").alias("c_depth"),
        F.col("pre").alias("c_pre"),
        *([F.col("path").alias("c_path"), F.col("route").alias("c_route")] if paths else []),
    )
    pre = F.col("c_pre") + F.col("chain_pos")
    found = inside.join(chains, "chain").select(
        "node",
        "parent",
        F.lit("tree").alias("status"),
        "root",
        (F.col("c_depth") + F.col("chain_pos")).cast("int").alias("depth"),
        F.col("size").alias("subtree_size"),
        "chain",
        "chain_pos",
        pre.alias("pre"),
        (pre + F.col("size") - 1).alias("last"),
        F.lit(None).cast("string").alias("cycle_id"),
        *(
            [
                F.concat("c_path", "seg").alias("path"),
                F.concat("c_route", F.array(F.struct(F.col("chain"), F.col("chain_pos").alias("pos")))).alias("route"),
            ]
            if paths
            else []
        ),
    )
    if lost_rows is None:
        return found
    ring = _cycles(st, lost_rows)
    lost = ring.select(
        "node",
        "parent",
        F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("status"),
        F.lit(-1).alias("depth"),
        "cycle_id",
    )
    return found.unionByName(lost, allowMissingColumns=True)


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of every node and each proper ancestor, from ``hierarchy(paths=True)``.

    A node's route names at most log2(n) chains with the position where it leaves each; the nodes of a
    chain up to that position are its ancestors. The join is on the chain, so no pairs are tried that
    are not in the result beyond the tail of one chain; the result itself has sum(depth) rows.
    """
    route = tree.filter(F.col("status") == "tree").select("node", "depth", F.explode("route").alias("leg"))
    on_chain = tree.filter(F.col("status") == "tree").select(
        F.col("node").alias("ancestor"), F.col("depth").alias("a_depth"), F.col("chain").alias("a_chain"), F.col("chain_pos").alias("a_pos")
    )
    return (
        route.join(on_chain, (F.col("leg.chain") == F.col("a_chain")) & (F.col("a_pos") <= F.col("leg.pos")))
        .filter(F.col("ancestor") != F.col("node"))
        .select("ancestor", "node", (F.col("depth") - F.col("a_depth")).alias("distance"))
    )


def descendants_of(tree: DataFrame, wanted: DataFrame, bucket: int = 4096) -> DataFrame:
    """(ancestor, node) for each id in ``wanted`` (column node): one preorder interval per ancestor.

    An interval is cut at multiples of ``bucket``; the pieces meet the nodes of their root and bucket only. A
    piece that fills its bucket takes all of it and the at most two others are compared, so that nothing is
    tried beyond two buckets an ancestor that is not in the result, however large the tree."""
    ask = wanted.select("node").distinct().join(tree.filter(F.col("status") == "tree"), "node").filter(F.col("last") > F.col("pre"))
    low, high = F.col("pre") + 1, F.col("last")
    ask = ask.select(F.col("node").alias("ancestor"), "root", low.alias("low"), high.alias("high"))
    pieces = ask.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    nodes = tree.filter(F.col("status") == "tree").select("node", "root", "pre", F.floor(F.col("pre") / bucket).alias("cell"))
    return nodes.join(pieces, ["root", "cell"]).filter((F.col("pre") >= F.col("low")) & (F.col("pre") <= F.col("high"))).select("ancestor", "node")
