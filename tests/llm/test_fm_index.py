import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm.contamination import prepare, search_shard
from sylvan.llm.fm_index import FMIndex, suffix_array
from sylvan.llm.leak_words import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=8))
def test_occurrences_equal_a_scan(text, phrases):
    text = np.array(text, np.int64)
    index = FMIndex(text, 5, sample=3)
    low, high = index.find(np.array(phrases))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array_sorts_suffixes(text):
    text = [*text, 0]
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


ITEM = "Write TunnelCatalog to stage a gantry whose remote parent sits 8 levels above the lane and explain why seal_pending_mirror never returns before the tray has been drained twice by hand"


def found(doc, items=((1, ITEM),)):
    p = prepare(list(items))
    return search_shard(p, [7], [np.array([p.codes.get(w, 1) for w in words(doc)], np.int64)])


def test_reshaped_copies_are_found():
    ws = ITEM.split()
    exchanged = " ".join("zebra" if i % 9 == 5 else w for i, w in enumerate(ws))
    variants = [
        ITEM,
        ITEM.upper(),
        "x " + ITEM.replace(" ", "\n> ") + " y",
        ITEM.replace("a", "а").replace("e", "е"),
        "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in ITEM),
        ITEM.replace("stage", "st​age").replace("remote", "<b>remote</b>"),
        '{"p": "' + ITEM.replace("_", "\\_") + '"}',
        " ".join(ws[15:]) + " and then other words. " + " ".join(ws[:15]),
        exchanged,
        "pre " + " ".join(ws[: len(ws) // 2 + 1]),
    ]
    for v in variants:
        assert found(v) and found(v)[0][:2] == (7, 1), v


def test_quotes_templates_and_shared_instructions_are_not():
    ws = ITEM.split()
    assert not found("he wrote: " + " ".join(ws[3:11]) + " and so on")
    other = " ".join("zebra" if i % 3 == 1 else w for i, w in enumerate(ws))
    assert not found(other)
    shared = "Answer with a single code block and do not add any explanation before or after it."
    items = [(i, f"Item {i} asks about thing{i} number{i} only. {shared}") for i in range(5)]
    assert not found("something else. " + shared, items)
    assert {r[1] for r in found(items[2][1], items)} <= {2}


def test_spans_empty_items_and_empty_texts():
    hit = found("one two " + ITEM)
    assert hit[0][3] == [{"start": 2, "stop": 2 + len(words(ITEM))}] and hit[0][2] == 1.0
    assert not found("", ((1, ""), (2, "a b")))
    assert search_shard(prepare([]), [1], [np.array([1, 2])]) == []


def test_whole_operator(spark):
    from pyspark.sql import functions as F

    from sylvan.llm.contamination import leaked_items

    docs = [(1, ITEM), (1, ITEM), (2, "nothing here"), (3, None), (None, ITEM), (4, ""), (5, "filler " * 4000 + ITEM)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(9)).withColumn("share", F.lit("x"))
    items = spark.createDataFrame([(11, ITEM), (11, ITEM), (12, None), (None, "q"), (13, "unrelated words of another item entirely")], "item_id bigint, text string")
    for blocks in (20_000, 1):
        got = leaked_items(documents, items, shard_words=500, max_items=blocks)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 11), (5, 11)} and got.count() == 2
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaked_items(none, items).count() == 0 and leaked_items(documents, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


CHINESE = "请编写一个函数读取所有队列中的记录并且按照到达的时间顺序输出结果如果队列为空则返回零"


def test_scripts_without_blanks_and_long_tags():
    assert found("这是另一段文字。" + CHINESE + "。结束", ((1, CHINESE),)) and not found("请编写一个函数", ((1, CHINESE),))
    tag = '<a title="' + "x " * 400 + '" href=y>'
    assert words(f"one {tag}two</a> three") == ["one", "two", "three"]
    assert words("if (i <n && j> m) __a_b__ _") == ["if", "i", "m", "a_b"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=8, max_size=40), st.lists(st.lists(st.integers(0, 7), max_size=60), min_size=1, max_size=4))
def test_few_seeds_never_hide_a_pair(item, docs):
    """All pairs grown from every seed, without the filter on the number of seeds."""
    from sylvan.llm import contamination

    p = prepare([(1, " ".join(f"w{i}" for i in item))])
    texts = [np.array([p.codes.get(f"w{i}", 1) for i in d], np.int64) for d in docs]
    got = {r[:3] for r in search_shard(p, list(range(len(docs))), texts, occurrences=5)}
    kept, contamination.SEEDS_PER_WORD = contamination.SEEDS_PER_WORD, 0.0
    want = {r[:3] for r in search_shard(p, list(range(len(docs))), texts)}
    contamination.SEEDS_PER_WORD = kept
    assert got == want
