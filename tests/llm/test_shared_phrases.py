import numpy as np

from sylvan.llm.contamination import leaked_items, prepare, search_shard
from sylvan.llm.leak_words import words
from sylvan.llm.shared_phrases import shared_places, with_shared_places

SHARED = "Answer with a single code block and do not add any explanation before or after it."
COPY = " ".join(f"alpha{i} beta{i % 5} gamma{i * 7}" for i in range(14))
VERSIONS = [" ".join(f"slot{k}" if i == 20 else w for i, w in enumerate(COPY.split())) for k in range(4)]
ITEMS = [(i, f"Item {i} asks about thing{i} number{i} only. {SHARED}") for i in range(6)] + [(10 + i, COPY) for i in range(3)] + [(20 + i, v) for i, v in enumerate(VERSIONS)]


def test_an_instruction_is_shared_whatever_the_blocks(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    documents = spark.createDataFrame([(1, SHARED), (2, ITEMS[2][1]), (3, COPY), (4, VERSIONS[1])], "doc_id bigint, text string")
    one, many = ({(r["doc_id"], r["item_id"], round(r["share"], 9), str(r["spans"])) for r in leaked_items(documents, items, max_items=n).collect()} for n in (1000, 2))
    assert one == many and not any(doc == 1 for doc, *_ in one)


def test_copies_and_versions_of_one_text_are_found():
    p = prepare(ITEMS)
    hit = {r[1] for r in search_shard(p, [7], [np.array([p.codes.get(w, 1) for w in words(COPY)], np.int64)])}
    assert hit == {10, 11, 12, 20, 21, 22, 23}


def test_the_table_and_the_list_give_the_same_places(spark):
    got = {r["item_id"]: r["places"] for r in with_shared_places(spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()}
    want = dict(zip([i for i, _ in ITEMS], shared_places([words(t) for _, t in ITEMS])))
    assert got == want and want[3] and not want[10] and not want[21]
