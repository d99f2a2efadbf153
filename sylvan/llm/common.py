"""Small helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.session import parallelism


def tasks(spark: SparkSession) -> int:
    """Partitions for a stage that runs Python over texts: never fewer than three a core."""
    return max(parallelism(spark), 3 * spark.sparkContext.defaultParallelism)


def one_content(contents: DataFrame, n: int) -> DataFrame:
    """One content per path (the rows of a path are equal; should they differ, the greatest text counts).

    The explicit partition number keeps AQE from merging the partitions that Python works on, and the
    grouping and later joins on path reuse it."""
    return contents.filter(F.col("path").isNotNull()).select("path", "content").repartition(n, "path").groupBy("path").agg(F.max("content").alias("content"))


def files_with_content(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Current record of each path with its content (inner join; null contents are kept)."""
    n = tasks(files.sparkSession)
    record = (
        files.filter(F.col("path").isNotNull())
        .select("path", "language", "size", "indexed_at")
        .repartition(n, "path")
        .groupBy("path")
        .agg(F.max(F.struct("indexed_at", "language", "size")).alias("r"))
        .select("path", "r.language", "r.size")
    )
    return record.join(one_content(contents, n), "path")


def repository(path):
    """First component of a path written with either separator."""
    return F.regexp_extract(path, r"^[/\\]*([^/\\]+)", 1)
