"""Evaluation texts leaking into training text.

Every split of the corpus is indexed shard by shard with an FM-index over words; all short phrases of
all evaluation items are searched in it at once, their occurrences located and grown into running
stretches. The items travel to the corpus, so no text is shuffled. Three equal words in a row stand in
every stretch that can count, so searching three-word phrases loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.fm_index import FMIndex
from sylvan.llm.leak_words import stretches, words
from sylvan.llm.shared_phrases import COMMON_WORDS, shared_places, with_shared_places
from sylvan.session import spread
from sylvan.staging import Staging
from sylvan.tables import read

SEED = 3
SHORTEST = 8
SHARE = 0.4
SHARD_WORDS = 400_000
MAX_ITEMS, MAX_CHARS = 100_000, 64_000_000  # what one pass over the corpus holds: bounds the broadcast
#: seeds a pair must have per word of the item: an own word that counts lies in a phrase of three equal words, or is
#: an exchanged one beside such; 0.4 of the words cannot come together from fewer than 0.07 seeds a word
SEEDS_PER_WORD = 0.05

FOUND = "doc_id bigint, item_id bigint, share double, spans array<struct<start:int,stop:int>>"


@dataclass
class ItemSet:
    """Evaluation items as word codes, in flat arrays: 1 is a word no item has, item words follow from 2 on."""

    codes: dict[str, int]
    ids: list[int]
    words: np.ndarray  # of all items, one after the other
    begin: np.ndarray  # where each item begins, and the end
    own: np.ndarray  # which words belong to no phrase shared by many items
    phrases: np.ndarray
    first: np.ndarray  # per phrase: where its places begin, and the end
    at_item: np.ndarray  # places: item and position in it
    at_word: np.ndarray


def prepare(rows: list[tuple[int, str]], places: list[list[int]] | None = None) -> ItemSet:
    """Places: where in each item shared phrases begin, if that was counted over more items than these."""
    codes: dict[str, int] = {}
    split = [words(t) for _, t in rows]
    sizes = np.array([len(ws) for ws in split], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.fromiter((codes.setdefault(w, len(codes) + 2) for ws in split for w in ws), np.int64, int(begin[-1]))
    own = np.ones(len(flat), bool)
    for k, at in enumerate(shared_places(split) if places is None else places):
        for j in at:
            own[begin[k] + j : min(begin[k] + j + COMMON_WORDS, begin[k + 1])] = False
    item = np.repeat(np.arange(len(split)), sizes)
    word = np.arange(len(flat)) - begin[item]
    starts = np.flatnonzero(word + SEED <= sizes[item])
    triples = np.stack([flat[starts + i] for i in range(SEED)], 1) if len(starts) else np.zeros((0, SEED), np.int64)
    some_own = np.any([own[starts + i] for i in range(SEED)], axis=0) if len(starts) else np.zeros(0, bool)
    triples, starts = triples[some_own], starts[some_own]
    phrases, of = np.unique(triples, axis=0, return_inverse=True) if len(triples) else (triples, np.zeros(0, np.int64))
    order = np.argsort(of.ravel(), kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(of.ravel(), minlength=len(phrases))))).astype(np.int64)
    return ItemSet(codes, [i for i, _ in rows], flat, begin, own, phrases, first, item[starts[order]], word[starts[order]])


def spread_out(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... of each range in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def search_shard(found: ItemSet, ids: list[int], texts: list[np.ndarray], occurrences: int = 1 << 22) -> list[tuple]:
    """Pairs of one shard of documents (word codes each); seeds are laid out ``occurrences`` or so at a time."""
    if not len(found.phrases) or not texts:
        return []
    # Runs of words that no item has are one symbol: no phrase crosses them.
    parts, origin, owner = [], [], []
    for ws in texts:
        keep = np.ones(len(ws), bool)
        keep[1:] = (ws[1:] != 1) | (ws[:-1] != 1)
        at = np.flatnonzero(keep)
        parts += [ws[at], np.array([1])]
        origin += [at, np.array([len(ws)])]
        owner.append(len(at) + 1)
    text = np.concatenate(parts)
    place = np.concatenate(origin)
    doc_of = np.repeat(np.arange(len(texts)), owner)
    index = FMIndex(text, len(found.codes) + 2)
    low, high = index.find(found.phrases)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return []
    phrase = np.repeat(hit, (high - low)[hit])
    at = index.locate(spread_out(low[hit], (high - low)[hit]))
    # by document, so that all seeds of a pair are laid out together
    order = np.argsort(doc_of[at], kind="stable")
    phrase, docs, starts = phrase[order], doc_of[at][order], place[at][order]
    many = (found.first[1:] - found.first[:-1])[phrase]
    total = np.cumsum(many)
    sizes = found.begin[1:] - found.begin[:-1]
    edges = np.append(np.flatnonzero(np.diff(docs)) + 1, len(docs))
    out, a = [], 0
    while a < len(docs):
        reach = np.searchsorted(total, (total[a - 1] if a else 0) + occurrences)
        b = int(edges[min(np.searchsorted(edges, reach + 1), len(edges) - 1)])
        where = spread_out(found.first[phrase[a:b]], many[a:b])
        item, word = found.at_item[where], found.at_word[where]
        doc, shift = np.repeat(docs[a:b], many[a:b]), np.repeat(starts[a:b], many[a:b]) - word
        pair = doc * len(sizes) + item
        # different positions of the item that are hit, per pair
        longest = int(sizes.max()) + 1
        hits = np.unique(pair * longest + word)
        pairs, counts = np.unique(hits // longest, return_counts=True)
        likely = pairs[counts >= SEEDS_PER_WORD * sizes[pairs % len(sizes)]]
        chosen = np.isin(pair, likely)
        order = np.lexsort((word[chosen], shift[chosen], pair[chosen]))
        rows = np.stack((pair[chosen][order], shift[chosen][order], word[chosen][order]), 1)
        for group in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else ():
            d, k = divmod(int(group[0, 0]), len(sizes))
            got = grow(found, k, texts[d], group[:, 1:].tolist())
            if got:
                out.append((ids[d], found.ids[k], *got))
        a = b
    return out


def grow(found: ItemSet, k: int, text: np.ndarray, seeds: list[list[int]]) -> tuple[float, list[dict[str, int]]] | None:
    """Share and spans of item ``k`` in a document, from its seeds (shift, position) in order; None below ``SHARE``."""
    begin, end = int(found.begin[k]), int(found.begin[k + 1])
    ws, own = found.words[begin:end].tolist(), found.own[begin:end]
    shortest = min(SHORTEST, len(ws))
    covered = np.zeros(len(ws), bool)
    spans, diagonal, stop = [], None, -1
    for shift, j in seeds:
        if shift != diagonal:
            diagonal, stop = shift, -1
        if j < stop:
            continue
        a, stop = stretches(ws, text, j, shift)
        if stop - a >= shortest:
            covered[a:stop] = True
            spans.append((a + shift, stop + shift))
    share = float((covered & own).sum()) / len(ws)
    return (share, merge(spans)) if share >= SHARE else None


def merge(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _searcher(shared, shard_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: ItemSet = shared.value
        codes = found.codes
        ids: list[int] = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(search_shard(found, ids, texts), columns=["doc_id", "item_id", "share", "spans"])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ws = np.array([codes.get(w, 1) for w in words(text)], np.int64)
                # a text that holds no three item words in a row cannot match
                if len(ws) < SEED or not ((ws[2:] > 1) & (ws[1:-1] > 1) & (ws[:-2] > 1)).any():
                    continue
                ids.append(int(doc_id))
                texts.append(ws)
                held += len(ws)
                if held >= shard_words:
                    yield flush()
                    ids.clear()
                    texts.clear()
                    held = 0
        yield flush()

    return run


def leaked_items(documents: DataFrame, items: DataFrame, *, shard_words: int = SHARD_WORDS, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, share of the item's words that the document reproduces, spans of document words to remove.

    A pair counts from a share of two fifths on, in running stretches of eight words or more (all of a shorter
    item). Layout, case, punctuation, markup, encoding, order of stretches and single exchanged words do not
    matter; words in phrases that three or more different items share are not counted (equal and nearly equal texts are
    one item there, see ``shared_phrases``). Null ids and texts take no part, items
    under three words never match (in scripts written without blanks each letter is a word), repeated rows give
    a pair once, empty tables give no rows, other columns are ignored. Items are sent to the corpus in blocks of
    about ``max_items`` and ``MAX_CHARS`` characters; each block is a pass over the corpus that indexes every shard
    once, and what is shared among items is counted over all of them, so that blocks change no result.
    """
    spark = documents.sparkSession
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // max_items), -(-size["chars"] // MAX_CHARS))
    if blocks > 1:  # what is shared is counted over all items, not over those of one block
        items = Staging(spark, "items").put(with_shared_places(items), "places")
    docs = spread(documents.select("doc_id", "text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out = None
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = sorted(tuple(r) for r in block.collect())  # at most about max_items rows
        places = [r[2] for r in rows] if blocks > 1 else None
        shared = spark.sparkContext.broadcast(prepare([r[:2] for r in rows], places))
        part = docs.mapInPandas(_searcher(shared, shard_words), FOUND)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "spans")).alias("m"))
    return best.select("doc_id", "item_id", "m.share", "m.spans")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), F.to_json("spans").alias("spans"))


QUERIES = {"p6_found": p6_found, "p6_spans": p6_spans}
SQL: dict[str, str] = {}
