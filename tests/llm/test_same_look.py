import pytest
from pyspark.sql import functions as F

from sylvan.llm.lookalike import candidates, odd_tokens, plain_form
from sylvan.llm.same_look import same_look_pairs, unify_texts

BASE = "Please keep the anchor cache of résumé files, since ﬁne files cost 3² bytes."


def test_plain_form_keeps_what_one_can_see():
    assert plain_form("Ｆｕｌｌ １２") == "Full 12" and plain_form("ﬁx") == "fix" and plain_form("a b c") == "a b c"
    assert plain_form("é") == "é" and plain_form("a​b­c﻿") == "abc" and plain_form("a․b;") == "a.b;"
    for seen in ("3²", "é", "œ", "ß", "½", "①"):
        assert plain_form(seen) == seen or seen == "½"
    assert plain_form("") == ""


def test_candidates_go_to_the_script_that_tells():
    assert candidates("аnchor", "Latin")[0] == "anchor" and candidates("со", "Latin") == ["co"]
    assert candidates("anchor", "Latin") == [] and candidates("модуль", "Latin") == []
    assert odd_tokens("Старый beacon_tаble.с удалён")[0][3][0] == "table"


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("look", F.lit(1)).withColumn("form", F.lit("z"))
    return {tuple(r) for r in same_look_pairs(df).collect()}


def test_pairs(spark):
    rows = [
        (1, BASE), (2, BASE.replace("a", "а")), (3, BASE.replace(" ", " ")), (4, BASE.replace("é", "é")), (5, BASE.replace("keep", "ke​ep")), (6, BASE), (7, BASE.replace("²", "2")),
        (8, BASE.replace("é", "e")), (9, BASE.replace("Please", "please")), (10, None), (None, BASE), (11, ""), (12, "​"), (1, BASE),
    ]
    same = [1, 2, 3, 4, 5, 6]
    want = {(a, b) for i, a in enumerate(same) for b in same[i + 1 :] if (a, b) != (1, 6)} | {(11, 12)}
    assert pairs(spark, rows) == want
    assert pairs(spark, []) == set()


def test_repair_needs_a_word_of_the_corpus(spark):
    rows = spark.createDataFrame([(1, "plain words only: tunnel"), (2, "the tunnеl and zyxwvе"), (3, "Старый модуль"), (4, "Старый мoдуль")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in unify_texts(rows).collect()}
    assert got[2] == "the tunnel and zyxwvе" and got[4] == got[3]


@pytest.mark.parametrize("long", [20_000])
def test_long_text(spark, long):
    text = "anchor tray " * long
    assert pairs(spark, [(1, text), (2, text + "​")]) == {(1, 2)}


def test_words_are_cut_alike_in_spark_and_python(spark):
    from sylvan.llm.lookalike import TOKEN, pieces
    from sylvan.llm.same_look import _tokens, _words

    texts = ["loadHTTPQueue AbCDe x_Y ABcDe aBcD", "ÜberMäßig ДваСлова ABCd", "", "__ 12 a1B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.flatten(F.transform(_tokens(F.col("t")), _words)).alias("words")).collect():
        assert [w for w in r["words"] if w] == [p for m in TOKEN.findall(r["t"]) for p in pieces(m)]


def test_one_hot_form(spark):
    """Many copies of one text and a few respelled twins: links are counted by look, pairs are as by brute force."""
    from sylvan.llm.same_look import same_look_classes

    rows = [(i, BASE) for i in range(300)] + [(1000 + i, BASE.replace(" ", "\u00a0", i + 1)) for i in range(3)] + [(2000, "another text")]
    want = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if x != y and 2000 not in (a, b)}
    assert pairs(spark, rows) == want
    links = {r["doc_id"]: r["n_links"] for r in same_look_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert links == {d: sum(d in p for p in want) for d, _ in rows}
