import random

from pyspark.sql import functions as F

from sylvan.operators.hierarchy import ancestor_pairs, contains_links, descendants_of, hierarchy


def build(spark, links, members):
    return hierarchy(spark.createDataFrame(links, "child string, parent string"), spark.createDataFrame(members, "node string, label string"))


def brute(links, members):
    parent = {}
    for child, p in links:
        parent[child] = min(p, parent.get(child, p))
    out = {}
    for n in members:
        path, seen, at = [n], {n}, n
        while at in parent and parent[at] in members:
            at = parent[at]
            if at in seen:
                ring = path[path.index(at):]
                out[n] = (None, -1, min(ring), "cycle" if n in ring else "below_cycle")
                break
            seen.add(at)
            path.append(at)
        else:
            out[n] = (at, len(path) - 1, "/".join(reversed(path)), "tree")
    return out


def test_random_forests_with_cycles_match_walking(spark):
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(160)]
    links = []
    for i, n in enumerate(names):
        r = rng.random()
        if r < 0.75 and i:
            links.append((n, names[rng.randrange(i)] if rng.random() < 0.4 else names[i - 1]))
        elif r < 0.85:
            links.append((n, names[rng.randrange(len(names))]))
    links.append((names[0], names[3]))
    rows = {r["node"]: r for r in build(spark, links, [(n, n) for n in names]).collect()}
    want = brute(links, set(names))
    assert rows.keys() == want.keys()
    below = {n: set() for n in names}
    for n, (top, depth, third, status) in want.items():
        r = rows[n]
        assert (r["status"], r["depth"]) == (status, depth)
        if status == "tree":
            assert (r["root"], r["path"]) == (top, third)
            for a in third.split("/"):
                below[a].add(n)
        else:
            assert r["cycle_id"] == third
    for n, (*_, status) in want.items():
        if status == "tree":
            assert rows[n]["subtree_size"] == len(below[n])
            inside = {m for m in names if rows[m]["root"] == rows[n]["root"] and rows[m]["pre"] is not None and rows[n]["pre"] <= rows[m]["pre"] <= rows[n]["last"]}
            assert inside == below[n]


def test_one_long_chain_and_one_wide_parent(spark):
    deep = [(f"d{i:04d}", f"d{i - 1:04d}") for i in range(1, 300)]
    wide = [(f"w{i:04d}", "w0000") for i in range(1, 400)]
    members = [(f"d{i:04d}", "x") for i in range(300)] + [(f"w{i:04d}", "x") for i in range(400)]
    tree = build(spark, deep + wide, members).cache()
    assert tree.agg(F.max("depth")).first()[0] == 299
    pre = [r["pre"] for r in tree.filter("root = 'w0000'").collect()]
    assert sorted(pre) == list(range(400))
    assert tree.filter("node = 'd0299'").first()["path"].count("/") == 299
    below = descendants_of(tree, spark.createDataFrame([("d0297",), ("w0000",)], "node string"))
    assert {r["node"] for r in below.filter("ancestor = 'd0297'").collect()} == {"d0298", "d0299"}
    assert below.filter("ancestor = 'w0000'").count() == 399
    assert ancestor_pairs(tree).filter("node = 'd0299'").count() == 299


def test_self_parent_null_ends_repeats_unknown_ends_and_empty(spark):
    links = [("a", "a"), ("b", "a"), ("c", None), (None, "a"), ("d", "e"), ("d", "e"), ("f", "nowhere")]
    rows = {r["node"]: r for r in build(spark, links, [(x, None) for x in "abcdef"] + [("a", None), (None, "z")]).collect()}
    assert set(rows) == set("abcdef")
    assert rows["a"]["cycle_id"] == rows["b"]["cycle_id"] == "a"
    assert (rows["a"]["status"], rows["b"]["status"]) == ("cycle", "below_cycle")
    assert (rows["d"]["root"], rows["d"]["path"], rows["f"]["depth"]) == ("e", "e/d", 0)
    assert build(spark, [], []).count() == 0


def test_links_by_id_before_qualified_name_and_extra_columns(spark, nodes_df, edges_df):
    nodes = nodes_df(
        [
            {"id": "1", "qualified_name": "f#A", "updated_at": 1},
            {"id": "2", "qualified_name": "f#A::m", "updated_at": 5},
            {"id": "2", "qualified_name": "old", "updated_at": 2},
            {"id": "3", "qualified_name": None, "updated_at": None},
        ]
    ).withColumn("key", F.lit("x")).withColumn("child", F.lit(1))
    edges = edges_df(
        [
            {"source": "1", "target": "f#A::m", "kind": "contains"},
            {"source": "1", "target": "2", "kind": "contains"},
            {"source": "1", "target": "old", "kind": "contains"},
            {"source": "1", "target": "3", "kind": "CONTAINS"},
            {"source": "9", "target": "3", "kind": "contains"},
            {"source": None, "target": "3", "kind": "contains"},
        ]
    ).withColumn("parent", F.lit("y"))
    assert {tuple(r) for r in contains_links(nodes, edges).collect()} == {("2", "1")}


def test_descendants_by_pieces_of_intervals(spark):
    """Every bucket width gives the descendants that walking gives; a node without children has none."""
    from sylvan.operators.hierarchy import descendants_of, hierarchy

    parent = {i: (i - 1) // 3 for i in range(1, 60)} | {100: 101, 101: 100}
    names = sorted({str(i) for i in range(60)} | {"100", "101"})
    links = spark.createDataFrame([(str(c), str(p)) for c, p in parent.items()], "child string, parent string")
    tree = hierarchy(links, spark.createDataFrame([(n, n) for n in names], "node string, label string"), paths=False).persist()

    def below(p):
        kids = [c for c, q in parent.items() if q == p]
        return {str(c) for c in kids} | {x for c in kids for x in below(c)}

    want = {("0", n) for n in below(0)} | {("1", n) for n in below(1)} | {("7", n) for n in below(7)}
    ask = spark.createDataFrame([("0",), ("1",), ("7",), ("59",), ("100",), ("gone",), ("1",)], "node string")
    for width in (1, 4, 4096):
        assert {tuple(r) for r in descendants_of(tree, ask, width).collect()} == want
    tree.unpersist()
