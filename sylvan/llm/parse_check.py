"""Source files that do not parse.

Every current file with content goes through the recursive-descent parser of its language (all
spellings of a language taken together); all errors are stored with the first cause, and rates follow
per repository and language. One shuffle brings records and contents together by path; parsing is a
map over it, so cost and memory depend on single files only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import files_with_content, repository
from sylvan.tables import read

SCHEMA = "path string, language string, valid boolean, cause string, n_errors int, errors array<struct<line:int,message:string>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from sylvan.llm.syntax import canonical_language, check_source

    for pdf in batches:
        rows = []
        for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
            language = canonical_language(language)
            valid, cause, errors = check_source(content, language)
            rows.append((path, language, valid, cause, len(errors), [{"line": n, "message": m} for n, m in errors]))
        yield pd.DataFrame(rows, columns=["path", "language", "valid", "cause", "n_errors", "errors"])


def parse_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """path, repository, language, valid, cause, n_errors, errors of each current file with content.

    Null or blank content is valid; so is any content of an unknown or null language (nothing is known
    to be broken). Repeated rows count once, null paths are left out, empty tables give no rows, and
    columns beyond those named are ignored. Texts are parsed whole, whatever their length.
    """
    found = files_with_content(files, contents).select("path", "language", "content").mapInPandas(_parse, SCHEMA)
    return found.select("path", repository(F.col("path")).alias("repository"), "language", "valid", "cause", "n_errors", "errors")


def rejection_rates(parsed: DataFrame) -> DataFrame:
    """Files and share of files that do not parse, per repository and language."""
    bad = F.sum((~F.col("valid")).cast("long"))
    return parsed.groupBy("repository", "language").agg(
        F.count("*").alias("n_files"), bad.alias("n_invalid"), (bad / F.count("*")).alias("invalid_rate")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_files(read(spark, d, "files"), read(spark, d, "file_contents")).filter(~F.col("valid")).select("path")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_files(read(spark, d, "files"), read(spark, d, "file_contents"))
    return parsed.withColumn("errors", F.to_json("errors"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return rejection_rates(parse_files(read(spark, d, "files"), read(spark, d, "file_contents")))


QUERIES = {"p4_found": p4_found, "p4_files": p4_files, "p4_rates": p4_rates}
SQL: dict[str, str] = {}
