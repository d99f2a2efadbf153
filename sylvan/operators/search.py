"""Symbol search, binding of names to symbols, and lookup of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.functions.kinds import WORKSPACE_RANK, lookup
from sylvan.functions.terms import like_pattern, rank_term


def search_symbols(nodes: DataFrame, pattern: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Top symbols whose name matches a wildcard pattern regardless of case: names equal to the pattern
    (case counts) first, then shorter ones, then by place. An empty pattern finds every symbol."""
    hit = nodes.filter(F.col("name").ilike(like_pattern(pattern)))
    if kind is not None:
        hit = hit.filter(F.col("kind") == kind)
    rank = F.when(F.col("name") == rank_term(pattern), 0).otherwise(1)
    return (
        hit.withColumn("rank", rank)
        .orderBy("rank", F.length("name"), "file_path", "start_line", "id")
        .limit(limit)
        .select("id", "name", "kind", "file_path", "start_line", "rank")
    )


def node_names(nodes: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Distinct names with a prefix (LIKE wildcards in it count), in order."""
    like = prefix.replace("\\", "\\\\") + "%"
    return nodes.filter(F.col("name").ilike(like)).select("name").distinct().orderBy("name").limit(limit)


def bind_names(nodes: DataFrame, names: DataFrame, name: str = "name", candidates: int = 1) -> DataFrame:
    """Best symbols for each name: equal name before equal qualified name, shorter qualified names first.

    A batch of names is joined on one exploded key (name and qualified name), never with OR."""
    keys = F.explode(
        F.array_distinct(F.array(F.struct(F.col("name").alias("key"), F.lit(0).alias("by")), F.struct(F.col("qualified_name").alias("key"), F.lit(1).alias("by"))))
    )
    index = nodes.select("id", "name", "qualified_name", "file_path", "start_line", "kind", keys.alias("k")).select("*", "k.key", "k.by").drop("k")
    index = index.filter(~((F.col("by") == 1) & (F.col("key") == F.col("name"))))
    wanted = names.select(F.col(name).alias("wanted")).filter(F.col("wanted").isNotNull()).distinct()
    order = W.partitionBy("wanted").orderBy("by", F.length("qualified_name"), "file_path", "start_line", "id")
    return (
        wanted.join(index, F.col("wanted") == F.col("key"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= candidates)
        .select("wanted", "rank", "id", "kind", "file_path")
    )


LINE_BUCKET = 256


def _line_buckets(start: Column, end: Column) -> Column:
    """A row for each run of ``LINE_BUCKET`` lines that a range touches: ranges of one file then meet only those
    places that lie in the same run, however long the file is."""
    high = F.greatest(start, end)
    return F.explode(F.sequence(F.floor(start / LINE_BUCKET), F.floor(high / LINE_BUCKET)))


def innermost_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """The tightest symbol around each (file_path, line, col): fewest lines, then the latest start.

    A range join kept to runs of lines of single files; points outside any symbol give no row."""
    spans = nodes.select("id", "name", "kind", "file_path", "start_line", "end_line", "start_column", "end_column").filter(F.col("end_line") >= F.col("start_line"))
    spans = spans.withColumn("cell", _line_buckets(F.col("start_line"), F.col("end_line")))
    p = points.select(F.col("file_path").alias("p_path"), "line", "col").filter(F.col("line").isNotNull() & F.col("col").isNotNull()).distinct()
    inside = (
        (F.col("start_line") <= F.col("line"))
        & (F.col("end_line") >= F.col("line"))
        & ~((F.col("start_line") == F.col("line")) & (F.col("start_column") > F.col("col")))
        & ~((F.col("end_line") == F.col("line")) & (F.col("end_column") < F.col("col")))
    )
    order = W.partitionBy("p_path", "line", "col").orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), F.desc("start_column"), "id")
    return (
        p.withColumn("p_cell", F.floor(F.col("line") / LINE_BUCKET))
        .join(spans, (F.col("p_path") == F.col("file_path")) & (F.col("p_cell") == F.col("cell")))
        .filter(inside)
        .withColumn("rank", F.row_number().over(order))
        .filter("rank = 1")
        .select("file_path", "line", "col", "id", "name", "kind")
    )


def enclosing_parent(nodes: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """For every symbol the tightest other symbol of its file whose lines hold it (``kinds`` limits the
    containers): the parent in an outline."""
    child = nodes.select("id", "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    outer = nodes if kinds is None else nodes.filter(F.col("kind").isin(*kinds))
    outer = outer.select(F.col("id").alias("parent_id"), F.col("file_path").alias("o_path"), "start_line", "end_line").filter(F.col("end_line") > F.col("start_line"))
    outer = outer.withColumn("cell", _line_buckets(F.col("start_line"), F.col("end_line")))  # one holds the child's first line
    child = child.withColumn("c_cell", F.floor(F.col("s") / LINE_BUCKET))
    width = F.col("end_line") - F.col("start_line")
    holds = (F.col("start_line") <= F.col("s")) & (F.col("end_line") >= F.col("e")) & (width > F.col("e") - F.col("s"))
    order = W.partitionBy("id").orderBy(width, F.desc("start_line"), "parent_id")
    return (
        child.join(outer, (F.col("file_path") == F.col("o_path")) & (F.col("c_cell") == F.col("cell")) & holds)
        .withColumn("rank", F.row_number().over(order))
        .filter("rank = 1")
        .select("id", "parent_id")
    )


def workspace_symbols(nodes: DataFrame, pattern: str, per_file: int = 6, limit: int = 50) -> DataFrame:
    """Symbols for an editor's picker: callables first, a few per file."""
    hit = nodes.filter(F.col("name").ilike(like_pattern("*" + pattern + "*")) & ~F.col("kind").isin("import", "export", "parameter"))
    hit = hit.withColumn("rank", lookup(WORKSPACE_RANK, F.col("kind"), 5))
    spot = F.row_number().over(W.partitionBy("file_path").orderBy("rank", "start_line", "id"))
    return (
        hit.withColumn("spot", spot)
        .filter(F.col("spot") <= per_file)
        .orderBy("rank", "start_line", "file_path", "id")
        .limit(limit)
        .select("id", "name", "kind", "file_path", "start_line", "rank")
    )
