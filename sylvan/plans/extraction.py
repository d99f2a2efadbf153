"""Queries that read symbols and relations out of file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.extract.run import extract_rows, links_of, nodes_of, unresolved_of
from sylvan.functions.columns import language_of
from sylvan.plans.symbols import files
from sylvan.session import parallelism
from sylvan.staging import Staging
from sylvan.tables import read

CALL_SITE = r"([A-Za-z_][A-Za-z0-9_.]*)\("
TABLE_REF = r"(?i)exec sql[^;]*?\b(?:from|into|update|join)\s+([A-Za-z_][A-Za-z0-9_.]*)"


def rows(s: SparkSession, d: str) -> DataFrame:
    """Symbols and links of all current files, parsed once and kept in the shared folder."""
    n = max(parallelism(s), 3 * s.sparkContext.defaultParallelism)
    one = read(s, d, "file_contents").filter("path is not null").repartition(n, "path").groupBy("path").agg(F.max("content").alias("content"))
    record = files(s, d).select("path")
    found = one.join(record, "path", "left_semi").withColumn("language", language_of(F.col("path"), F.col("content"))).filter("language is not null")
    return Staging(s, "extract").put(extract_rows(found), "rows")


def contents(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "file_contents").groupBy("path").agg(F.max("content").alias("content"))


def call_sites(s: SparkSession, d: str) -> DataFrame:
    sites = contents(s, d).select("path", F.explode(F.regexp_extract_all("content", F.lit(CALL_SITE), F.lit(1))).alias("callee"))
    return sites.groupBy("path", "callee").agg(F.count("*").alias("n"))


def sql_tables(s: SparkSession, d: str) -> DataFrame:
    found = contents(s, d).select("path", F.explode(F.regexp_extract_all("content", F.lit(TABLE_REF), F.lit(1))).alias("name"))
    return found.groupBy("path", "name").agg(F.count("*").alias("n"))


QUERIES = {
    "extract_symbols": lambda s, d: nodes_of(rows(s, d)),
    "extract_relations": lambda s, d: links_of(rows(s, d)),
    "extract_unresolved": lambda s, d: unresolved_of(rows(s, d)),
    "extract_kind_counts": lambda s, d: nodes_of(rows(s, d)).groupBy("language", "kind").agg(F.count("*").alias("n")),
    "callback_edges": lambda s, d: links_of(rows(s, d)).filter("provenance = 'heuristic'"),
    "call_sites": call_sites,
    "sql_table_refs": sql_tables,
}
_ONE = "one AS (SELECT path, max(content) AS content FROM file_contents GROUP BY path)"
SQL = {
    "call_sites": f"WITH {_ONE}, x AS (SELECT path, unnest(regexp_extract_all(content, '{CALL_SITE}', 1)) AS callee FROM one) SELECT path, callee, count(*) AS n FROM x GROUP BY ALL",
    "sql_table_refs": f"WITH {_ONE}, x AS (SELECT path, unnest(regexp_extract_all(content, '{TABLE_REF}', 1)) AS name FROM one) SELECT path, name, count(*) AS n FROM x GROUP BY ALL",
}
