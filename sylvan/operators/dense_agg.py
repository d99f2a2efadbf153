"""Per-key results when a handful of keys hold most of the rows.

Each input split, whatever keys it holds, encodes its keys with a dictionary of its own and adds its
rows into dense numpy arrays (``bincount`` for counts, scatter-min and -max for the ends). The arrays
leave the split cut into blocks of the key space, one partial entry per key and split, so the heaviest
key costs no more to shuffle than any other. Within a block partial arrays come in the order of their keys
and are summed run by run, so that neither the number of keys nor that of splits must fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.session import parallelism

_LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class BlockAccumulator:
    """Dense arrays over the codes of a growing dictionary of keys."""

    def __init__(self) -> None:
        self.codes: dict = {}
        self.keys: list = []
        self.rows = np.zeros(0, np.int64)
        self.distinct = np.zeros(0, np.int64)
        self.low = np.zeros(0, np.int64)
        self.high = np.zeros(0, np.int64)

    def encode(self, batch: pa.StructArray) -> np.ndarray:
        """Codes of a batch of keys: encoded once per distinct key of the batch."""
        local = pc.dictionary_encode(batch)
        mapping = np.empty(len(local.dictionary), np.int64)
        for i, key in enumerate(local.dictionary.to_pylist()):
            mapping[i] = self.codes.setdefault(key, len(self.codes))
            if mapping[i] == len(self.keys):
                self.keys.append(key)
        short = len(self.keys) - len(self.rows)
        if short:
            self.rows = np.append(self.rows, np.zeros(short, np.int64))
            self.distinct = np.append(self.distinct, np.zeros(short, np.int64))
            self.low = np.append(self.low, np.full(short, _LOW))
            self.high = np.append(self.high, np.full(short, _HIGH))
        return mapping[local.indices.to_numpy(zero_copy_only=False)]

    def add(self, codes: np.ndarray, rows: np.ndarray | None, distinct: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> None:
        n = len(self.keys)
        if rows is not None:
            # bincount sums in doubles, exact below 2^53
            self.rows += np.bincount(codes, weights=rows, minlength=n).astype(np.int64)
        if distinct is not None:
            self.distinct += np.bincount(codes, weights=distinct, minlength=n).astype(np.int64)
        np.minimum.at(self.low, codes, low)
        np.maximum.at(self.high, codes, high)


_PART = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_distinct", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [("block", pa.int32()), ("key", pa.string()), ("n_rows", pa.int64()), ("n_distinct", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
)


def _split(blocks: int, flush_keys: int):
    """Partial arrays of one input split. A split with very many keys empties its arrays when they
    reach ``flush_keys`` entries, so memory is bounded whatever the split holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = BlockAccumulator()
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = acc.encode(batch.column(0))
            value = batch.column(1).cast(pa.int64())
            acc.add(
                codes,
                batch.column(2).to_numpy(zero_copy_only=False),
                batch.column(3).to_numpy(zero_copy_only=False),
                pc.fill_null(value, _LOW).to_numpy(zero_copy_only=False),
                pc.fill_null(value, _HIGH).to_numpy(zero_copy_only=False),
            )
            if len(acc.keys) >= flush_keys:
                yield _emit(acc, blocks)
                acc = BlockAccumulator()
        if acc.keys:
            yield _emit(acc, blocks)

    return run


def _emit(acc: BlockAccumulator, blocks: int) -> pa.RecordBatch:
    import xxhash

    block = np.fromiter((xxhash.xxh32_intdigest(k) % blocks for k in acc.keys), np.int32, len(acc.keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(block), pa.array(acc.keys, pa.string()), *map(pa.array, (acc.rows, acc.distinct, acc.low, acc.high))], schema=_ARROW
    )


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partial arrays of a block, which come in the order of their keys: one segment sum per batch,
    the last key of which waits for the next batch."""
    held: list | None = None  # the open key with its sums

    def out(rows: list[list]) -> pa.RecordBatch:
        key, n_rows, n_distinct, low, high = zip(*rows)
        return _summed(pa.array(key, pa.string()), np.array(n_rows, np.int64), np.array(n_distinct, np.int64), np.array(low, np.int64), np.array(high, np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        same = pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False)
        start = np.concatenate(([0], np.flatnonzero(~same) + 1))
        num = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_rows", "n_distinct", "low", "high")}
        n_rows, n_distinct = np.add.reduceat(num["n_rows"], start), np.add.reduceat(num["n_distinct"], start)
        low, high = np.minimum.reduceat(num["low"], start), np.maximum.reduceat(num["high"], start)
        first = keys.take(pa.array(start))
        if held is not None:
            if held[0] == first[0].as_py():
                n_rows[0] += held[1]
                n_distinct[0] += held[2]
                low[0], high[0] = min(low[0], held[3]), max(high[0], held[4])
            else:
                yield out([held])
        last = len(start) - 1
        held = [first[last].as_py(), int(n_rows[last]), int(n_distinct[last]), int(low[last]), int(high[last])]
        if last:
            yield _summed(first.slice(0, last), n_rows[:last], n_distinct[:last], low[:last], high[:last])
    if held is not None:
        yield out([held])


def _summed(keys: pa.Array, n_rows: np.ndarray, n_distinct: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    ends = [pa.array(low, mask=low == _LOW), pa.array(high, mask=high == _HIGH)]
    return pa.RecordBatch.from_arrays([keys, pa.array(n_rows), pa.array(n_distinct), *ends], names=["key", "n_rows", "n_distinct", "low", "high"])


def dense_key_stats(
    rows: DataFrame,
    keys: list[str],
    member: str | None,
    value: str,
    *,
    blocks: int | None = None,
    flush_keys: int = 200_000,
) -> DataFrame:
    """Rows, distinct non-null members, and first and last value of each key.

    Returns ``keys`` (strings) with n_rows, n_sources, first_line and last_line (as BIGINT columns cast
    back to the value's type). Null keys form a group of their own; null members are not counted; null
    values are skipped, all-null gives null. Empty input gives no rows. Other columns are ignored.
    Without ``member`` distinct members are not counted (n_sources 0), which spares the shuffle of all pairs.
    ``blocks`` is the number of pieces of the key space that are summed apart (default: four times the tasks
    that can run at once).
    """
    spark = rows.sparkSession
    blocks = blocks or 4 * parallelism(spark)
    kind = rows.schema[value].dataType
    key = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    one = rows.select(key.alias("key"), F.col(value).cast("long").alias("v"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("d"))
    run = _split(blocks, flush_keys)
    parts = one.mapInArrow(run, _PART)
    if member is not None:
        # Each (key, member) pair once: spread by both, and reduced on the map side before the shuffle.
        pairs = rows.filter(F.col(member).isNotNull()).select(key.alias("key"), F.col(member).alias("m")).distinct()
        two = pairs.select("key", F.lit(None).cast("long").alias("v"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
        parts = parts.unionByName(two.mapInArrow(run, _PART))
    out = "key string, n_rows bigint, n_distinct bigint, low bigint, high bigint"
    total = parts.repartition(blocks, "block").sortWithinPartitions("key").drop("block").mapInArrow(_sum_runs, out)
    back = F.from_json("key", T.StructType([T.StructField(f"k{i}", T.StringType()) for i in range(len(keys))]))
    return total.withColumn("k", back).select(
        *[F.col(f"k.k{i}").cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(keys)],
        "n_rows",
        F.col("n_distinct").alias("n_sources"),
        F.col("low").cast(kind).alias("first_line"),
        F.col("high").cast(kind).alias("last_line"),
    )
