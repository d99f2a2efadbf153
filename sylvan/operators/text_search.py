"""Full-text search over file contents: inverted index, BM25, proximity of words, line clusters."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.functions.columns import text_lines, tokens
from sylvan.staging import Staging

K1, B = 1.2, 0.75


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length) of every document and word. Nothing is collected per word."""
    words = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return words.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def _count(w: str, term: str) -> Column:
    """How often a word, or the parts of a compound (``bind_frame``) in a row, stand in the words ``w``."""
    parts = [p for p in re.split(r"[\W_]+", term) if p]
    if not parts:
        return F.lit(0)

    def here(word: Column, i: Column) -> Column:
        same = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(F.col(w), i + k) == part)
        return same

    return F.size(F.filter(w, here))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of the documents that hold any of the terms, Okapi BM25 as SQLite's full-text search has it.

    A term of several words counts where they follow each other. For given terms no index is built: one scan
    takes their counts, keeps the documents that hold any, and while it writes these sums up the number and
    length of all documents and how many hold each term."""
    terms = sorted(set(t.lower() for t in terms))
    w = tokens(F.coalesce(F.col(text), F.lit("")))
    counted = docs.select(key, w.alias("w")).select(
        key, F.size("w").alias("length"), *[_count("w", t).alias(f"tf{i}") for i, t in enumerate(terms)]
    )
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | (F.col(f"tf{i}") > 0)
    facts = Observation()
    sums = [F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    seen = counted.observe(facts, F.count("*").alias("n"), F.sum("length").alias("words"), *sums)
    held = Staging(docs.sparkSession, "bm25").put(seen.filter(some), "counts")
    known = facts.get
    n, mean = known["n"], (known["words"] or 0) / max(1, known["n"])
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), known[f"df{i}"] or 0
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    return held.select(key, score.alias("score"))


def _hit_lines(docs: DataFrame, key: str, text: str, terms: list[str]) -> tuple[DataFrame, Column]:
    lines = docs.select(key, F.posexplode(text_lines(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("pos", "line"))
    hits = [F.col("line").contains(t).cast("int").alias(f"h{i}") for i, t in enumerate(terms)]
    total = sum((F.col(f"h{i}") for i in range(1, len(terms))), F.col("h0"))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), *hits).filter(total > 0), total


def proximity(docs: DataFrame, key: str, text: str, terms: list[str], width: int = 80) -> DataFrame:
    """Best window of ``width`` lines per document: most different terms, then most hits, then the first.

    Only lines with a hit begin a window that can win, and only those are kept; the window looks ahead by
    line numbers, so the lines between cost nothing."""
    some, total = _hit_lines(docs, key, text, terms)
    ahead = W.partitionBy(key).orderBy("line_no").rangeBetween(0, width - 1)
    n_terms = sum((F.max(f"h{i}").over(ahead) for i in range(1, len(terms))), F.max("h0").over(ahead))
    density = F.sum(total).over(ahead)
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n_terms"), F.desc("density"), "line_no"))
    return (
        some.withColumn("n_terms", n_terms)
        .withColumn("density", density)
        .withColumn("rank", best)
        .filter("rank = 1")
        .select(key, F.col("line_no").cast("bigint").alias("line_no"), F.col("n_terms").cast("bigint").alias("n_terms"), F.col("density").cast("bigint").alias("density"))
    )


def window_hits(docs: DataFrame, key: str, text: str, terms: list[str], width: int = 80) -> DataFrame:
    """The best window of each document (see ``proximity``) with what stands in it: (key, n_terms, density,
    matched: which of the terms, hit_lines: at most ``width`` line numbers)."""
    best = proximity(docs, key, text, terms, width).withColumnRenamed("line_no", "first")
    some, _ = _hit_lines(docs, key, text, terms)
    inside = some.join(best, key).filter((F.col("line_no") >= F.col("first")) & (F.col("line_no") < F.col("first") + width))
    matched = F.array(*[F.max(f"h{i}") for i in range(len(terms))])
    return inside.groupBy(key, "n_terms", "density").agg(matched.alias("matched"), F.collect_list("line_no").alias("hit_lines"))


def line_clusters(ranges: DataFrame, key: str, padding: int = 3, gap: int = 5) -> DataFrame:
    """Padded line ranges (key, start_line, end_line) merged where they are at most ``gap`` lines apart."""
    padded = ranges.select(
        key,
        F.greatest(F.col("start_line") - padding, F.lit(1)).alias("s"),
        (F.greatest("end_line", "start_line") + padding).alias("e"),
    ).distinct()
    order = W.partitionBy(key).orderBy("s", "e")
    seen = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    flagged = padded.withColumn("seen", seen)
    flagged = flagged.withColumn("fresh", (F.col("seen").isNull() | (F.col("s") > F.col("seen") + gap)).cast("int"))
    island = F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))
    return flagged.withColumn("island", island).groupBy(key, "island").agg(F.min("s").alias("start_line"), F.max("e").alias("end_line")).drop("island")
