import random
from collections import defaultdict

from pyspark.sql import functions as F

from sylvan.operators.dense_agg import dense_key_stats

SCHEMA = "target string, kind string, source string, line int"


def brute(rows):
    got = defaultdict(lambda: [0, set(), None, None])
    for t, k, s, n in rows:
        g = got[t, k]
        g[0] += 1
        if s is not None:
            g[1].add(s)
        if n is not None:
            g[2] = n if g[2] is None else min(g[2], n)
            g[3] = n if g[3] is None else max(g[3], n)
    return {k: (a, len(b), c, d) for k, (a, b, c, d) in got.items()}


def collect(df):
    return {(r["target"], r["kind"]): (r["n_rows"], r["n_sources"], r["first_line"], r["last_line"]) for r in df.collect()}


def test_hot_key_ties_repeats_and_nulls_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot", "calls", f"s{rng.randrange(9)}", rng.randrange(50)) for _ in range(700)]
    rows += [(rng.choice(["a", "b", "", None]), rng.choice(["calls", None]), rng.choice(["x", None]), rng.choice([1, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for flush in (200_000, 3):
        assert collect(dense_key_stats(df, ["target", "kind"], "source", "line", flush_keys=flush)) == brute(rows)


def test_empty_input_and_clashing_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dense_key_stats(empty, ["target", "kind"], "source", "line").count() == 0
    one = spark.createDataFrame([("t" * 5000, "k", "s", 3)], SCHEMA).withColumn("key", F.lit(1)).withColumn("block", F.lit("q")).withColumn("n_rows", F.lit(9))
    assert collect(dense_key_stats(one, ["target", "kind"], "source", "line")) == {("t" * 5000, "k"): (1, 1, 3, 3)}


def test_partial_arrays_are_summed_across_batches():
    """Runs of one key over any cut into batches, against a plain count."""
    import random

    import pyarrow as pa

    from sylvan.operators.dense_agg import _HIGH, _LOW, _sum_runs

    rng = random.Random(3)
    rows = sorted((rng.choice("abcdef"), rng.randrange(9), rng.randrange(3), *rng.choice([(1, 5), (3, 4), (_LOW, _HIGH)])) for _ in range(60))
    for cuts in ([], [0], [1, 2, 3], [10, 10, 59], list(range(60))):
        edges = [0, *cuts, len(rows)]
        batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "n_rows", "n_distinct", "low", "high"), r)) for r in rows[a:b]], schema=pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("n_rows", "n_distinct", "low", "high"))])) for a, b in zip(edges, edges[1:])]
        got = [r for b in _sum_runs(iter(batches)) for r in b.to_pylist()]
        want = []
        for k in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == k]
            low, high = min(r[3] for r in own), max(r[4] for r in own)
            want.append({"key": k, "n_rows": sum(r[1] for r in own), "n_distinct": sum(r[2] for r in own), "low": None if low == _LOW else low, "high": None if high == _HIGH else high})
        assert got == want
    assert list(_sum_runs(iter([]))) == []
