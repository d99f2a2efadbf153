"""Schemas (DDL) of the code-graph tables and views of their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = (
    "id STRING, kind STRING, name STRING, qualified_name STRING, file_path STRING, language STRING, "
    "start_line INT, end_line INT, start_column INT, end_column INT, docstring STRING, signature STRING, "
    "visibility STRING, is_exported BOOLEAN, is_async BOOLEAN, is_static BOOLEAN, is_abstract BOOLEAN, "
    "decorators ARRAY<STRING>, type_parameters ARRAY<STRING>, updated_at BIGINT"
)
EDGES = (
    "edge_seq BIGINT, source STRING, target STRING, kind STRING, metadata MAP<STRING,STRING>, line INT, col INT, provenance STRING"
)
FILES = (
    "path STRING, content_hash STRING, language STRING, size BIGINT, modified_at BIGINT, indexed_at BIGINT, node_count INT, errors ARRAY<STRING>"
)
CONTENTS = "path STRING, content STRING"
REFS = (
    "ref_seq BIGINT, from_node_id STRING, reference_name STRING, reference_kind STRING, line INT, col INT, "
    "candidates ARRAY<STRING>, file_path STRING, language STRING, resolution_status STRING, resolution_reason STRING, resolution_attempted_at BIGINT"
)


METADATA = "key STRING, value STRING, updated_at BIGINT"
SCHEMAS = {"nodes": NODES, "edges": EDGES, "files": FILES, "file_contents": CONTENTS, "unresolved_refs": REFS}
VERSION = 1


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """A table written under an older schema in the form of the current one: columns it lacks are null, those it
    has under another type are cast, columns of its own stay behind the others."""
    want = df.sparkSession.createDataFrame([], schema).schema
    own = {f.name: f.dataType for f in df.schema}
    columns = [
        (F.lit(None).cast(f.dataType) if f.name not in own else F.col(f.name) if own[f.name] == f.dataType else F.col(f.name).cast(f.dataType)).alias(f.name)
        for f in want
    ]
    return df.select(*columns, *[c for c in df.columns if c not in want.fieldNames()])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the largest version (rows that tie are equal).

    A ``max`` of a struct combines on the map side, so a key delivered very often is reduced
    before the shuffle. Rows with a null key are left out; a null version counts as oldest.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    row = F.max(F.struct(F.col(version), *[F.col(c) for c in rest]))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_row")).select(key, "_row.*").select(*df.columns)


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """``latest`` where rows that tie are equal: every column is taken on its own from the row with the largest
    version, so that the columns a query does not use are neither read nor carried."""
    order = F.coalesce(F.col(version), F.lit(-(1 << 63)))
    rest = [F.max_by(c, order).alias(c) for c in df.columns if c not in (key, version)]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias(version), *rest).select(*df.columns)


def current_nodes(nodes: DataFrame) -> DataFrame:
    return newest(nodes, "id", "updated_at")


def current_files(files: DataFrame) -> DataFrame:
    return newest(files, "path", "indexed_at")
