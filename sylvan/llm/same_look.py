"""Visually identical text with different characters, brought to one form.

Widths, joined letters, blanks and invisible characters are folded per text. Look-alike letters of
another script are then replaced token by token, towards the script the token is (mostly) in, only if
the result is a word of the corpus. The vocabulary is counted over all texts and stays distributed:
the few odd tokens are looked up in it by a join, and only texts with odd tokens are touched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.session import spread
from sylvan.staging import Staging
from sylvan.tables import read

_ODD = "odd array<struct<start:int,stop:int,token:string,forms:array<string>>>"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from sylvan.llm.lookalike import odd_tokens, plain_form

    for pdf in batches:
        plain = [plain_form(t) for t in pdf["text"]]
        odd = [[{"start": a, "stop": b, "token": t, "forms": f} for a, b, t, f in odd_tokens(p)] for p in plain]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "look": pdf["look"], "plain": plain, "odd": odd})


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for plain, edits in zip(pdf["plain"], pdf["edits"]):
            parts, at = [], 0
            for e in sorted(edits, key=lambda e: e["start"]):
                parts += [plain[at : e["start"]], e["form"]]
                at = e["stop"]
            out.append("".join([*parts, plain[at:]]))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "look": pdf["look"], "text": out})


def _tokens(text):
    """Runs of letters; where all is ASCII a plain class is enough."""
    return F.split(text, F.when(_all_ascii(text), F.lit("[^A-Za-z]+")).otherwise(F.lit(r"[^\p{L}\p{M}]+")))


def _words(token):
    """Words of a token in lower case, cut at changes of case like ``lookalike.pieces``."""
    return F.transform(F.split(token, r"[^\p{L}\p{M}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"), F.lower)


def _all_ascii(text):
    return F.octet_length(text) == F.length(text)


def unify_texts(documents: DataFrame) -> DataFrame:
    """doc_id, look (hash of the text as it came), text (the one form).

    Null texts give no row, nor do null ids; empty texts stay empty; a row delivered twice comes out
    twice; columns other than doc_id and text are ignored. Differences one can see are kept: letters, case,
    accents, digits, raised figures. A look-alike is left where no word of the corpus supports the repair.
    """
    spark = documents.sparkSession
    st = Staging(spark, "look")
    rows = spread(documents.select("doc_id", "text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("look"))
    pure = _all_ascii(F.col("text"))
    schema = f"doc_id bigint, look string, plain string, {_ODD}"
    ascii_rows = rows.filter(pure).select("doc_id", "look", F.col("text").alias("plain"), F.array().cast(_ODD.split(" ", 1)[1]).alias("odd"))
    base = st.put(ascii_rows.unionByName(rows.filter(~pure).mapInPandas(_fold, schema)), "plain")

    forms = base.select(F.explode("odd").alias("o")).select("o.token", "o.forms").distinct()
    forms = st.put(forms.select("token", "forms", F.posexplode("forms").alias("rank", "form")), "forms")
    parts = forms.select("form", F.explode(_words(F.col("form"))).alias("word")).filter("word != ''").distinct()
    one_script = F.col("word").rlike(r"\A(?:\p{IsLatin}|\p{M})+\z|\A(?:\p{IsCyrillic}|\p{M})+\z|\A(?:\p{IsGreek}|\p{M})+\z")
    # counted by token first: cutting at changes of case is left to the different tokens
    tokens = base.select(F.explode(_tokens(F.col("plain"))).alias("token")).filter("token != ''").groupBy("token").agg(F.count("*").alias("n"))
    vocabulary = tokens.select(F.explode(_words(F.col("token"))).alias("word"), "n").filter(one_script).groupBy("word").agg(F.sum("n").alias("n"))
    support = (
        parts.join(vocabulary, "word", "left").groupBy("form").agg(F.min(F.coalesce("n", F.lit(0))).alias("support"))
    )
    approved = (
        forms.join(support, "form")
        .filter(F.col("support") > 0)
        .groupBy("token", "forms")
        .agg(F.max(F.struct("support", (-F.col("rank")).alias("first"), "form")).alias("best"))
        .select("token", "forms", F.col("best.form").alias("form"))
    )
    edits = (
        base.select("doc_id", "look", F.explode("odd").alias("o"))
        .select("doc_id", "look", "o.start", "o.stop", "o.token", "o.forms")
        .join(approved, ["token", "forms"])
        .groupBy("doc_id", "look")
        .agg(F.collect_set(F.struct("start", "stop", "form")).alias("edits"))
    )
    touched = base.filter(F.size("odd") > 0)
    mended = touched.join(edits, ["doc_id", "look"]).select("doc_id", "look", "plain", "edits").mapInPandas(_replace, "doc_id bigint, look string, text string")
    as_is = base.filter(F.size("odd") == 0).unionByName(touched.join(edits, ["doc_id", "look"], "left_anti"))
    return as_is.select("doc_id", "look", F.col("plain").alias("text")).unionByName(mended)


def same_look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, look, form, n_links: texts with one form look the same, texts with one look are equal; n_links is
    the number of rows that look like this one without being equal to it.

    Counted per look first, so that a text with any number of copies is one row of its form."""
    rows = unify_texts(documents).select("doc_id", "look", F.sha2("text", 256).alias("form"))
    rows = Staging(documents.sparkSession, "looks").put(rows.distinct(), "classes")
    looks = rows.groupBy("form", "look").agg(F.count("*").alias("equal"))
    forms = looks.groupBy("form").agg(F.sum("equal").alias("whole"), F.count("*").alias("n_looks")).filter("n_looks > 1")
    links = looks.join(forms, "form").select("form", "look", (F.col("whole") - F.col("equal")).alias("n_links"))
    return rows.join(links, ["form", "look"], "left").select("doc_id", "look", "form", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """Each pair of documents whose texts differ but look the same (doc_id_a < doc_id_b), once.

    Unequal looks are paired first, each look a single row however many copies it has; then both sides are
    replaced by their documents. Equal copies never meet, so nothing is tried that is not in the result."""
    st = Staging(documents.sparkSession, "pairs")
    rows = unify_texts(documents).select("doc_id", "look", F.sha2("text", 256).alias("form"))
    rows = st.put(rows.distinct(), "classes")
    mixed = rows.groupBy("form").agg(F.min("look").alias("a"), F.max("look").alias("b")).filter("a != b").select("form")
    rows = st.put(rows.join(mixed, "form", "left_semi"), "mixed")
    looks = rows.select("form", "look").distinct()
    unequal = looks.select("form", F.col("look").alias("one")).join(looks.select("form", F.col("look").alias("other")), "form").filter("one < other")
    left = rows.select("form", F.col("look").alias("one"), F.col("doc_id").alias("p"))
    right = rows.select("form", F.col("look").alias("other"), F.col("doc_id").alias("q"))
    found = unequal.join(left, ["form", "one"]).join(right, ["form", "other"]).filter("p != q")
    return found.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(read(spark, d, "documents"))


def p8_unified(spark: SparkSession, d: str) -> DataFrame:
    return unify_texts(read(spark, d, "documents")).select("doc_id", "text")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return same_look_classes(read(spark, d, "documents")).select("doc_id", "form", "n_links")


QUERIES = {"p8_found": p8_found, "p8_unified": p8_unified, "p8_classes": p8_classes}
SQL: dict[str, str] = {}
