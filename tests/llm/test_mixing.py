import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylvan.llm.mixing import TOKENIZER, mix_sources, sized_records, source_key

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the tokenizer's file")
DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark, docs, targets):
    documents = spark.createDataFrame(docs, DOCS).withColumn("tokens", F.lit("x")).withColumn("key", F.lit(1)).withColumn("bucket", F.lit(1))
    return documents, spark.createDataFrame(targets, TARGETS)


def test_shares_repeats_and_reference_selection(spark):
    docs = [(i, f"record number {i} with words " * (1 + i % 4), s) for i, s in enumerate(["big-one"] * 300 + ["Big_One "] * 30 + ["mid"] * 90 + ["small"] * 12 + ["other"] * 20 + [None] * 5)]
    docs += [(9001, None, "mid"), (9002, "", "mid"), (None, "x", "mid")]
    documents, targets = make(spark, docs, [("big-one", 0.5, 2), ("mid", 0.3, 3), ("small", 0.15, 6), ("none", 0.05, 4)])
    records, shares = mix_sources(documents, targets)
    rows, report = records.collect(), {r["source"]: r for r in shares.collect()}
    used = defaultdict(int)
    for r in rows:
        assert 1 <= r["copies"] <= {"big-one": 2, "mid": 3, "small": 6}[r["source"]]
        used[r["source"]] += r["copies"] * r["tokens"]
    total = sum(used.values())
    for s, want in (("big-one", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(used[s] / total - want / 0.95) < 0.01
        assert report[s]["used_tokens"] == used[s] and abs(report[s]["actual_share"] - used[s] / total) < 1e-12
    assert report["none"]["actual_share"] == 0 and {r["source"] for r in rows} == {"big-one", "mid", "small"}
    # the sample is the shortest prefix in key order that comes nearest to the budget
    sized = {r["doc_id"]: r for r in sized_records(documents, targets).collect()}
    keys = {r["doc_id"]: r["k"] for r in documents.filter("doc_id is not null").select("doc_id", (F.pmod(F.xxhash64(F.lit(20), F.col("doc_id")), F.lit(1 << 52)) + 0.5).alias("k")).collect()}
    import math

    key = lambda d: -math.log(keys[d] / (1 << 52)) / sized[d]["weight"]
    chosen = {r["doc_id"]: r["copies"] for r in rows}
    for s in ("big-one", "mid", "small"):
        own = sorted((d for d in sized if sized[d]["source"] == s), key=key)
        copies = [chosen.get(d, 0) for d in own]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1


def test_total_beyond_what_a_source_may_give(spark):
    documents, targets = make(spark, [(i, "some words here", "a" if i % 10 else "b") for i in range(100)], [("a", 0.5, 1), ("b", 0.5, 2)])
    records, shares = mix_sources(documents, targets, total_tokens=200)
    report = {r["source"]: r for r in shares.collect()}
    assert report["b"]["n_copies"] == 20 and report["b"]["epochs"] == 2 and report["a"]["used_tokens"] <= 101


def test_hot_source_empty_tables_and_ties(spark):
    documents, targets = make(spark, [(i, "same text", "a") for i in range(2000)], [("a", 1.0, 1), ("A", 0.0, None)])
    assert mix_sources(documents, targets, total_tokens=1000)[1].first()["used_tokens"] == 1000
    documents, targets = make(spark, [], [("a", 1.0, 1)])
    records, shares = mix_sources(documents, targets)
    assert records.count() == 0 and shares.first()["actual_share"] == 0.0
    documents, targets = make(spark, [(1, "x", "a")], [])
    assert mix_sources(documents, targets)[0].count() == 0
    assert spark.createDataFrame([(" Mail_Digest ",)], "s string").select(source_key(F.col("s"))).first()[0] == "mail-digest"


def test_both_kinds_of_tokenizer_file_count_alike():
    from sylvan.llm.mixing import TOKENIZER, token_counter

    texts = ["", "a", "def load(x):\n    return x  # été <|endoftext|> 日本", "don't  stop\t\n\n  it's", "\u200b\U0001f600 12345 " * 50]
    assert token_counter(TOKENIZER)(texts) == token_counter(TOKENIZER.replace(".tiktoken", ".json"))(texts)
