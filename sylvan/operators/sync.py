"""Incremental maintenance of a snapshot: what changed, and keyed replacement of what did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(stored: DataFrame, scanned: DataFrame, times: bool = False) -> DataFrame:
    """(path, state): added, deleted, changed or unchanged. ``stored`` has path, size, content_hash;
    ``scanned`` has path, size, content_hash. A full outer join on the path; null-safe comparison.
    With ``times`` both have modified_at, and equal size and time pass without a look at the hash."""
    extra = ["modified_at"] if times else []
    a = stored.select("path", *[F.col(c).alias(f"a_{c}") for c in ["size", "content_hash", *extra]], F.lit(True).alias("a"))
    b = scanned.select("path", *[F.col(c).alias(f"b_{c}") for c in ["size", "content_hash", *extra]], F.lit(True).alias("b"))
    same = F.col("a_size").eqNullSafe(F.col("b_size"))
    alike = F.col("a_content_hash").eqNullSafe(F.col("b_content_hash"))
    same = same & ((F.col("a_modified_at") == F.col("b_modified_at")) | alike if times else alike)
    same = F.coalesce(same, F.lit(False))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def scan_rows(contents: DataFrame) -> DataFrame:
    """(path, size, content_hash) of contents, one row per path."""
    one = contents.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max("content").alias("content"))
    return one.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("content_hash"))


def remove_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files in ``paths``: edges go with either end."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("id").alias("gone"))
    left = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    kept = edges.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti")
    return left, kept


def replace_rows(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``stored`` whose key ``fresh`` does not have, and all of ``fresh``: keyed replacement."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-replace of a batch: the last row of each key."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*").select(*rows.columns)


def requeue_incoming(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges from other files into the files that change, as references by name to be resolved again."""
    changed = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(
        F.col("id").alias("t_id"), F.col("name").alias("reference_name"), F.col("file_path").alias("t_path")
    )
    sources = nodes.select(F.col("id").alias("from_node_id"), F.col("file_path").alias("s_path"), "language")
    return (
        edges.join(changed, F.col("target") == F.col("t_id"))
        .join(sources, F.col("source") == F.col("from_node_id"))
        .filter(F.col("s_path") != F.col("t_path"))
        .select("from_node_id", "reference_name", F.col("kind").alias("reference_kind"), "line", "col", F.col("s_path").alias("file_path"), "language")
    )


def reopen_incoming(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges from other files into the files that change, with the target written as a name again."""
    dead = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(
        F.col("id").alias("t_id"), F.col("name").alias("t_name"), F.col("file_path").alias("t_path")
    )
    sources = nodes.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_path"))
    hit = edges.join(dead, F.col("target") == F.col("t_id")).join(sources, F.col("source") == F.col("s_id"))
    return hit.filter(F.col("s_path") != F.col("t_path")).withColumn("target", F.col("t_name")).select(*edges.columns)
