"""Functions paired with their documentation.

Every file is parsed into a syntax tree; its function nodes come out with their exact source range, their
parameters and the documentation attached to them (the comment above, or the string that opens the body).
They meet the current rows of the symbols on path, name and line. Statements of the documentation that are
empty, trivial or repeat the name, the parameters or their types are dropped, and functions that keep none.
The signature is parsed by itself only where the file has no such node (no content, or it does not parse).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.columns import language_of
from sylvan.llm.common import one_content, tasks
from sylvan.tables import read

TREE = "t_path string, t_name string, t_line int, t_end int, t_head string, t_params array<string>, t_returns string, t_doc string"
PARSED = (
    "node_id string, name string, language string, file_path string, start_line int, end_line int, signature string, params array<string>, returns string, "
    "description string, range_from string, doc_from string"
)


def _trees(with_code: bool):
    columns = [c.split()[0] for c in TREE.split(", ")] + (["t_code"] if with_code else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sylvan.llm.syntax import functions_of

        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                seen = set()
                for f in functions_of(content, language):
                    if (f.name, f.line) not in seen:
                        seen.add((f.name, f.line))
                        rows.append((path, f.name, f.line, f.end_line, f.head, f.params, f.returns, f.doc, *([f.code] if with_code else [])))
            yield pd.DataFrame(rows, columns=columns)

    return run


def function_nodes(contents: DataFrame, with_code: bool = False) -> DataFrame:
    """The function nodes of all files (``TREE``; with ``t_code`` the source of each): one row per path, name and line.

    The language is that of the path. Null paths and contents and unknown languages give no rows, repeated
    contents count once, text that does not parse gives the functions that were read without fault."""
    one = one_content(contents, tasks(contents.sparkSession)).filter(F.col("content").isNotNull())
    found = one.withColumn("language", language_of(F.col("path"), F.col("content"))).filter(F.col("language").isNotNull())
    return found.select("path", "language", "content").mapInPandas(_trees(with_code), TREE + (", t_code string" if with_code else ""))


def _same_words(a: str, b: str) -> bool:
    import re

    return re.findall(r"\w+", b) == re.findall(r"\w+", a)[-len(re.findall(r"\w+", b)) :]


def _describe(with_code: bool):
    columns = [c.split()[0] for c in PARSED.split(", ")] + (["code"] if with_code else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sylvan.llm.docs import describe, from_tree

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = r.t_params is not None
                tree = from_tree(r.name, list(r.t_params), r.t_returns, r.t_head, r.language or "") if found else None
                function, text = describe(r.docstring, r.name, r.signature, r.language, tree)
                if text is not None:
                    attached = found and r.t_doc is not None and _same_words(r.t_doc, r.docstring)
                    start, end = (r.t_line, r.t_end) if found else (r.start_line, r.end_line)
                    rows.append(
                        (r.id, r.name, r.language, r.file_path, start, end, r.signature, [p for p, _ in function.params], function.returns, text,
                         "tree" if found else "row", "tree" if attached else "row", *([r.t_code if found else r.signature] if with_code else []))
                    )
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def documented_functions(nodes: DataFrame, contents: DataFrame, kinds: tuple[str, ...] = ("function", "method"), with_code: bool = False) -> DataFrame:
    """One row per function or method whose current row has a signature and a documentation that says something.

    The documentation is that of the symbol's row; doc_from tells whether the syntax tree of the file has it
    attached to the function (``tree``) or the row alone does (``row``), range_from the same of the source range.
    The current row of an id is that with the largest updated_at. Null ids are left out; null or blank
    signatures and docstrings give no pair; rows that tie are equal; repeats count once; empty tables give
    no rows; other columns are ignored. description holds the statements that say something.
    """
    cols = ["kind", "name", "docstring", "signature", "language", "file_path", "start_line", "end_line"]
    n = tasks(nodes.sparkSession)
    current = (
        nodes.filter(F.col("id").isNotNull())
        .select("id", "updated_at", *cols)
        .repartition(n, "id")
        .groupBy("id")
        .agg(F.max(F.struct("updated_at", *cols)).alias("r"))
        .select("id", "r.*")
    )
    wanted = current.filter(F.col("kind").isin(*kinds) & (F.trim("signature") != "") & F.col("docstring").isNotNull()).drop("kind", "updated_at")
    trees = function_nodes(contents, with_code).repartition(n, "t_path", "t_name", "t_line")
    met = wanted.repartition(n, "file_path", "name", "start_line").join(
        trees, (F.col("file_path") == F.col("t_path")) & (F.col("name") == F.col("t_name")) & (F.col("start_line") == F.col("t_line")), "left"
    )
    return met.mapInPandas(_describe(with_code), PARSED + (", code string" if with_code else ""))


def code_description_pairs(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """``documented_functions`` with ``code``: the source range of the function node; where there is no node the
    symbol's lines of its file, or the signature where the file has no content or the range lies outside it."""
    pairs = documented_functions(nodes, contents, with_code=True)
    bare = pairs.filter(F.col("range_from") == "row")
    text = one_content(contents, tasks(nodes.sparkSession)).select(F.col("path").alias("file_path"), F.split(F.col("content"), "\r?\n").alias("rows"))
    found = bare.join(text, "file_path", "left")
    inside = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("start_line") <= F.size("rows"))
    lines = F.slice("rows", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    cut = found.withColumn("code", F.when(inside, F.array_join(lines, "\n")).otherwise(F.col("signature"))).drop("rows")
    return pairs.filter(F.col("range_from") == "tree").unionByName(cut)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(read(spark, d, "nodes"), read(spark, d, "file_contents")).select("node_id")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = code_description_pairs(read(spark, d, "nodes"), read(spark, d, "file_contents"))
    return pairs.select("node_id", "language", "code", "description", "range_from", "doc_from")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
SQL: dict[str, str] = {}
