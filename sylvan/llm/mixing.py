"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. Each source gets whole epochs of its records while they fit into
its budget and a weighted sample without replacement (Efraimidis-Spirakis: exponential keys scaled by
quality weights, smallest first) for the rest. The sample ends where the prefix sum of tokens in key
order meets the budget; the sums are taken over buckets of the key first, so of a source with a third of
all records only the one bucket that holds the cut is ever sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.session import spread
from sylvan.staging import Staging
from sylvan.tables import read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# -- fixed value: how the public byte-level vocabularies cut a text before merging ---------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY_BUCKETS = 4096
SEED = 20


def source_key(source: Column) -> Column:
    """Spellings of a source that differ in case, separator or blanks are one source."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-.]+", "-")


def quality_weight(text: Column) -> Column:
    """Share of letters and blanks in the text, at least 0.05."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / F.length(text)
    return F.greatest(F.lit(0.05), F.coalesce(plain, F.lit(0.05)))


def token_counter(path: str):
    """Texts to numbers of tokens, by a file of ranks (``.tiktoken``) or of a whole tokenizer (``.json``)."""
    if path.endswith(".tiktoken"):
        import base64

        from tiktoken import Encoding

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]


def _counter(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        count = token_counter(SparkFiles.get(name))
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "weight": pdf["weight"], "tokens": count(pdf["text"])})

    return run


def sized_records(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, weight: Column | None = None) -> DataFrame:
    """doc_id, source, weight, tokens of the records whose source has a target. The tokenizer's file, one the
    driver can read, is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    names = targets.select(source_key(F.col("source")).alias("source")).distinct()
    rows = spread(documents.select("doc_id", "text", "source")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    weight = quality_weight(F.col("text")) if weight is None else weight
    rows = rows.select("doc_id", "text", source_key(F.col("source")).alias("source"), weight.alias("weight"))
    rows = rows.join(names, "source", "left_semi").select("doc_id", "source", "weight", "text")
    return rows.mapInPandas(_counter(tokenizer.rsplit("/", 1)[-1]), "doc_id bigint, source string, weight double, tokens bigint").filter("tokens > 0")


def plan_budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, available, budget, epochs, rest.

    Without ``total_tokens`` the total is the largest at which no source needs more than max_repeats of its
    tokens, so that all shares come out as wanted among the sources that have records; with it, a source
    that cannot fill its share gives all it may."""
    wish = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = wish.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    share = F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(W.partitionBy())
    limit = F.when(usable, F.col("available") * F.col("max_repeats"))
    plan = plan.withColumn("part", F.when(usable, share)).withColumn("limit", limit)  # as many rows as targets
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(F.col("limit") / F.col("part")).over(W.partitionBy())
    budget = F.coalesce(F.least(F.col("part") * total, F.col("limit").cast("double")), F.lit(0.0))
    plan = plan.withColumn("budget", budget)
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available") + 1e-9), F.col("max_repeats"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("int"))
    return plan.withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("available"), F.lit(0.0))).select(
        "source", "target_share", "max_repeats", "available", "budget", "epochs", "rest"
    )


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    weight: Column | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(records, shares).

    records: doc_id, source, tokens, copies of each record used (1 to max_repeats). shares: per target the
    wanted and the actual share of all tokens used, epochs, records and copies. Records of sources without a
    target, with null ids or sources, or null or empty text are not used; a target without records gets
    share 0; a null max_repeats is 1; targets spelled alike are added; a doc_id that comes twice counts as
    two records with one key; empty tables give empty results; other columns are ignored.
    """
    st = Staging(documents.sparkSession, "mix")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    sized = sized_records(documents, targets, tokenizer, weight)
    sized = st.put(sized.withColumn("key", -F.log(u) / F.col("weight")), "sized")
    plan = st.put(plan_budgets(sized, targets, total_tokens), "plan")
    bucket = F.floor(F.lit(KEY_BUCKETS) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")  # grows with the key
    sized = sized.withColumn("bucket", bucket)
    sums = sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)  # at most KEY_BUCKETS rows a source
    cut = sums.join(plan.select("source", "epochs", "rest"), "source").withColumn(
        "state", F.when(F.col("before") + F.col("held") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("cut")
    )
    rows = sized.join(cut, ["source", "bucket"])
    whole = rows.filter("state != 'cut'").select("doc_id", "source", "tokens", (F.col("epochs") + (F.col("state") == "in").cast("int")).alias("copies"))
    running = F.coalesce(
        F.sum("tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    # the record at the cut is used if that comes nearer to the budget
    inside = F.col("before") + F.col("running") + F.col("tokens") / 2 <= F.col("rest")
    last = rows.filter("state = 'cut'").withColumn("running", running)
    last = last.select("doc_id", "source", "tokens", (F.col("epochs") + inside.cast("int")).alias("copies"))
    chosen = whole.unionByName(last).filter("copies > 0")
    used = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("n_records"), F.sum("copies").alias("n_copies")
    )
    shares = plan.join(used, "source", "left").fillna(0, ["used_tokens", "n_records", "n_copies"])
    shares = shares.withColumn("actual_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(W.partitionBy()), F.lit(0)))
    return chosen, shares.select(
        "source", "target_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), "max_repeats", "available", "used_tokens", "epochs", "n_records", "n_copies"
    )


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
