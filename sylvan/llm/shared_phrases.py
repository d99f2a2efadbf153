"""Which words of evaluation items belong to phrases that many different items share.

Counted over different texts, not ids. Texts that share four fifths of their words both ways are versions of one
text and count once: in each widely held phrase every text is compared with the smallest few keys that hold it, and
joins the smallest one it is a version of. An instruction at the head of otherwise different items stays shared.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.llm.leak_words import words
from sylvan.staging import Staging

COMMON_WORDS = 8
COMMON_ITEMS = 3
VERSION = 0.8
LEADERS = 8


def text_key(ws: list[str]) -> str:
    return hashlib.md5(" ".join(ws).encode("utf-8", "surrogatepass")).hexdigest()


def phrases(ws: list[str]) -> list[str]:
    return [" ".join(ws[j : j + COMMON_WORDS]) for j in range(len(ws) - COMMON_WORDS + 1)]


def covered(places: list[int]) -> int:
    return len({j + k for j in places for k in range(COMMON_WORDS)})


def shared_places(texts: list[list[str]]) -> list[list[int]]:
    """Per text (as words) where shared phrases begin; for a set that one process holds."""
    keys = [text_key(ws) for ws in texts]
    of = {key: phrases(ws) for key, ws in zip(keys, texts)}
    length = {key: len(ws) for key, ws in zip(keys, texts)}
    holders: dict[str, set[str]] = defaultdict(set)
    for key, ps in of.items():
        for p in ps:
            holders[p].add(key)
    wide = {p: sorted(ks) for p, ks in holders.items() if len(ks) >= COMMON_ITEMS}
    pairs = {(k, lead) for ks in wide.values() for lead in ks[:LEADERS] for k in ks if lead < k}
    sets = {key: set(of[key]) for pair in pairs for key in pair}
    versions: dict[str, str] = {}
    for k, lead in sorted(pairs):
        if k in versions:
            continue
        if all(covered([j for j, p in enumerate(of[a]) if p in sets[b]]) >= VERSION * length[a] for a, b in ((k, lead), (lead, k))):
            versions[k] = lead
    common = {p for p, ks in wide.items() if len({versions.get(k, k) for k in ks}) >= COMMON_ITEMS}
    return [[j for j, p in enumerate(of[key]) if p in common] for key in keys]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item_id, text in zip(pdf["item_id"], pdf["text"]):
            ws = words(text)
            rows.append((item_id, text, text_key(ws), len(ws), phrases(ws)))
        yield pd.DataFrame(rows, columns=["item_id", "text", "key", "n_words", "phrases"])


def with_shared_places(items: DataFrame) -> DataFrame:
    """item_id, text, places: the same as ``shared_places`` over a table of any size."""
    st = Staging(items.sparkSession, "shared")
    cut = st.put(items.mapInPandas(_cut, "item_id bigint, text string, key string, n_words int, phrases array<string>"), "items")
    at = st.put(cut.dropDuplicates(["key"]).select("key", "n_words", F.posexplode("phrases").alias("j", "p")), "phrases")
    held = at.select("key", "p").distinct()
    wide = st.put(held.join(held.groupBy("p").agg(F.count("*").alias("c")).filter(F.col("c") >= COMMON_ITEMS), "p").select("p", "key"), "wide")
    leaders = wide.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("key"))).filter(F.col("r") <= LEADERS).select("p", F.col("key").alias("lead"))
    pairs = wide.join(leaders, "p").filter(F.col("lead") < F.col("key")).select("key", "lead").distinct()
    both = pairs.join(at, "key").join(at.select(F.col("key").alias("lead"), "p", F.col("j").alias("lead_j"), F.col("n_words").alias("lead_n")), ["lead", "p"])

    def words_of(j: str):
        return F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(j), lambda x: F.sequence(x, x + (COMMON_WORDS - 1))))))

    near = both.groupBy("key", "lead", "n_words", "lead_n").agg(words_of("j").alias("a"), words_of("lead_j").alias("b"))
    near = near.filter((F.col("a") >= VERSION * F.col("n_words")) & (F.col("b") >= VERSION * F.col("lead_n")))
    versions = near.groupBy("key").agg(F.min("lead").alias("lead"))
    common = wide.join(versions, "key", "left").groupBy("p").agg(F.countDistinct(F.coalesce("lead", "key")).alias("c")).filter(F.col("c") >= COMMON_ITEMS)
    places = at.join(common.select("p"), "p").groupBy("key").agg(F.sort_array(F.collect_list("j")).alias("places"))
    return cut.join(places, "key", "left").select("item_id", "text", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
