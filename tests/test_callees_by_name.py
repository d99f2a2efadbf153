from sylvan.operators import graph
from sylvan.tables import current_nodes


def node(i, name, at=1):
    return {"id": i, "name": name, "kind": "function", "updated_at": at}


def call(source, target, line=1):
    return {"source": source, "target": target, "kind": "calls", "line": line, "col": 1}


def brute(nodes, edges):
    """Pairs over the newest row of each id."""
    names = {r["id"]: r["name"] for r in sorted(nodes, key=lambda r: r["updated_at"])}
    direct = {(e["source"], k) for e in edges if e["source"] in names and e["target"] for k, name in names.items() if e["target"] in (k, name)}
    return sorted((i, k) for i, name in names.items() for k in names if any(names[s] == name is not None and c == k for s, c in direct))


def test_a_callee_called_by_id_and_by_name_comes_once(spark, nodes_df, edges_df):
    nodes = [node("a1", "a"), node("a2", "a"), node("b1", "b"), node("b2", "b"), node("c", "c"), node("n", None), node("m", None)]
    nodes += [node("x", "b1"), node("a1", "old", 0), node("a2", "a")]  # a name that is another node's id, an older row, a repeat
    edges = [
        call("a1", "b1"), call("a2", "b1"), call("a1", "b"), call("a2", "b2", 7), call("a2", "b2", 8),  # by id, by name, again, from two of one name
        call("c", "c"), call("b1", "n"), call("n", "a"), call("b2", "a1"), call("c", None), call(None, "c"), call("gone", "a"), call("a1", "gone"),
    ]
    got = [tuple(r) for r in graph.callees(current_nodes(nodes_df(nodes)), edges_df(edges), by_name=True).collect()]
    assert sorted(got) == brute(nodes, edges) and ("a2", "x") in got and ("b1", "n") in got


def test_no_shuffle_holds_the_pairs(spark, nodes_df, edges_df):
    nodes = current_nodes(nodes_df([node(f"{n}{i}", n) for n in "ab" for i in range(30)]))
    out = graph.callees(nodes, edges_df([call("a0", "b"), call("a1", "b"), call("a2", "b3")]), by_name=True)
    top = out._jdf.queryExecution().optimizedPlan()
    while top.nodeName() == "Project":
        top = top.children().head()
    assert top.nodeName() == "Join", "nothing sorts or counts the pairs after the last join"
    assert out.count() == 900
