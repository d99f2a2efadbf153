"""Structured Streaming: a change feed applied to a snapshot, and change rates over event time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sylvan.staging import Staging


def latest_of(batch: DataFrame, key: str, version: str) -> DataFrame:
    rest = [c for c in batch.columns if c not in (key, version)]
    return batch.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r")).select(key, "r.*").select(*batch.columns)


class Book:
    """Which folder holds the current rows of each bucket of a snapshot: one small JSON entry per micro-batch."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _folder(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def read(self) -> dict:
        """The last entry that was written to its end."""
        fs, folder = self._folder(f"{self.base}/book")
        if not fs.exists(folder):
            return {"epoch": -1, "buckets": {}}
        whole = [s.getPath().getName() for s in fs.listStatus(folder) if fs.exists(self._folder(f"{self.base}/book/{s.getPath().getName()}/_SUCCESS")[1])]
        if not whole:
            return {"epoch": -1, "buckets": {}}
        last = max(whole, key=lambda n: int(n.rsplit("-", 1)[1]))
        return json.loads(self.spark.read.text(f"{self.base}/book/{last}", wholetext=True).first()[0])

    def write(self, entry: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(entry),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.base}/book/entry-{entry['epoch']}")

    def drop(self, path: str) -> None:
        fs, folder = self._folder(path)
        fs.delete(folder, True)

    def rows(self, schema: StructType) -> DataFrame:
        """The snapshot as it stands."""
        found = self.read()["buckets"]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{folder}/_bucket={b}" for b, folder in sorted(found.items())])


def apply_feed(feed: DataFrame, key: str, version: str, label: str = "feed", at: str | None = None, buckets: int = 32) -> DataFrame:
    """Runs a streaming feed of keyed records to its end and returns the snapshot it leaves: per key the record
    with the largest version, however late it came.

    The snapshot lies in buckets of the key's hash. A micro-batch is reduced to its newest record per key and
    merged with the buckets it touches, which alone are written again; an entry in the book then makes them the
    current ones, and a batch that comes again finds its entry and changes nothing. With ``at``, a folder all
    executors reach, the snapshot and the progress of the feed outlive the application and a restart goes on
    from there; else they lie in the shared folder of this run."""
    spark = feed.sparkSession
    st = Staging(spark, label)
    base = (at or f"{st.base}/snapshot").rstrip("/")
    book = Book(spark, base)

    def upsert(batch: DataFrame, epoch: int) -> None:
        seen = book.read()
        if epoch <= seen["epoch"]:
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = st.put(latest_of(batch.filter(F.col(key).isNotNull()), key, version), f"batch-{epoch}")
        touched = [str(r[0]) for r in fresh.select(bucket).distinct().collect()]  # at most ``buckets``
        before = {b: seen["buckets"][b] for b in touched if b in seen["buckets"]}
        merged = fresh
        if before:
            held = spark.read.schema(feed.schema).parquet(*[f"{base}/{folder}/_bucket={b}" for b, folder in before.items()])
            merged = latest_of(held.unionByName(fresh), key, version)
        if touched:
            merged.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{base}/epoch-{epoch}")
        book.write({"epoch": epoch, "buckets": seen["buckets"] | dict.fromkeys(touched, f"epoch-{epoch}")})
        for b, folder in before.items():
            book.drop(f"{base}/{folder}/_bucket={b}")
        st.drop(fresh)

    query = feed.writeStream.foreachBatch(upsert).trigger(availableNow=True).option("checkpointLocation", f"{base}/progress").start()
    query.awaitTermination()
    return book.rows(feed.schema)


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _timed(events: DataFrame, time: str, late: str) -> tuple[DataFrame, str]:
    """Events as a stream wants them: with a watermark, which takes no time without a zone; and the type to go back to."""
    kind = events.schema[time].dataType.simpleString()
    if not events.isStreaming:
        return events, kind
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), kind


def change_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number of events per type in tumbling windows of event time (works on streams and on tables)."""
    out, kind = _timed(events, time, late)
    return out.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast(kind).alias("window_start"), "event_type", "n")


def edit_sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Sessions of activity per user: events at most ``gap`` apart."""
    out, kind = _timed(events, time, gap)
    return out.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast(kind).alias("session_start"), "n")


def run_to_table(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a streaming result to its end into Parquet and returns the rows (append mode)."""
    spark = stream.sparkSession
    st = Staging(spark, label)
    path = f"{st.base}/rows"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{st.base}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Runs a streaming aggregation to the end of its feed and returns all groups as they then stand."""
    spark = stream.sparkSession
    st = Staging(spark, label)
    state: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, epoch: int) -> None:
        before = state.get("now")
        state["now"] = st.put(batch, f"groups-{epoch}")
        if before is not None:
            st.drop(before)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{st.base}/progress").start()
    query.awaitTermination()
    return state.get("now", spark.createDataFrame([], stream.schema))
