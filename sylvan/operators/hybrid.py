"""Ranked retrieval of symbols for a task text: several scored searches, fused per symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.functions.columns import is_non_prod, is_test_file, overlap
from sylvan.functions.kinds import IMPLEMENTATION_BIAS, LOW_VALUE, WEIGHT, lookup
from sylvan.functions.terms import match_terms, mentions_tests, query_symbols, query_terms, term_groups, title_case
from sylvan.operators.text_search import bm25, window_hits
from sylvan.staging import Staging


@dataclass(frozen=True)
class Task:
    """A task text taken apart."""

    text: str
    symbols: tuple[str, ...]
    terms: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]
    about_tests: bool

    @staticmethod
    def of(text: str) -> Task:
        terms = query_terms(text)
        wide = [t for t in terms if len(t) >= 3][:16]
        return Task(text, tuple(query_symbols(text)), tuple(terms), tuple(tuple(g) for g in term_groups(wide)), mentions_tests(text))


def path_relevance(terms: tuple[str, ...]) -> Column:
    return overlap(list(terms), F.col("file_path")) * 8


def kind_weight() -> Column:
    return lookup(WEIGHT, F.col("kind"), 0)


def _top(df: DataFrame, k: int, part: str | None = None) -> DataFrame:
    over = W.partitionBy(part) if part else W.partitionBy(F.lit(0))
    order = over.orderBy(F.desc("score"), F.length("name"), "file_path", "start_line", "id")
    if part is None:
        return df.orderBy(F.desc("score"), F.length("name"), "file_path", "start_line", "id").limit(k)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def _arm(df: DataFrame, arm: str) -> DataFrame:
    return df.select("id", "name", "file_path", "start_line", F.round("score", 6).alias("score"), F.lit(arm).alias("arm"))


def _beginnings(name: Column, words: list[str]) -> Column:
    """A row for each of a query's words that the name begins with."""
    return F.explode(F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.coalesce(name.startswith(w), F.lit(False))))


def exact_arm(nodes: DataFrame, task: Task) -> DataFrame:
    """Symbols named in the text."""
    hit = nodes.filter(F.col("name").isin(*task.symbols) if task.symbols else F.lit(False))
    return _arm(hit.withColumn("score", 120.0 + kind_weight() + path_relevance(task.terms)), "exact")


def like_arm(nodes: DataFrame, task: Task, search_limit: int = 5) -> DataFrame:
    """Names that begin with a word of the text; per word the first by length."""
    hit = nodes.filter(~F.col("kind").isin(*LOW_VALUE)).withColumn("term", _beginnings(F.lower("name"), list(task.terms)))
    order = W.partitionBy("term").orderBy(F.when(F.col("name") == F.col("term"), 0).otherwise(1), F.length("name"), "file_path", "start_line", "id")
    hit = hit.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 4 * search_limit)
    low = F.lower("name")
    lexical = kind_weight() + F.when(low == F.col("term"), 45).when(low.startswith(F.col("term")), 30).when(low.contains(F.col("term")), 18).otherwise(10)
    score = 55.0 + lexical + path_relevance(task.terms)
    if not task.about_tests:
        score = F.when(is_test_file(F.col("file_path")), score * 0.35).otherwise(score)
    best = hit.withColumn("score", score).groupBy("id", "name", "file_path", "start_line").agg(F.max("score").alias("score"))
    return _arm(best, "like")


def prefix_arm(nodes: DataFrame, task: Task, search_limit: int = 5) -> DataFrame:
    """Definitions whose name begins with a word of the text in title case."""
    titles = [title_case(t) for t in task.terms if len(t) >= 3]
    hit = nodes.filter(F.col("kind").isin("class", "struct", "interface", "trait", "protocol", "function", "method", "enum", "type_alias", "component"))
    hit = hit.withColumn("title", _beginnings(F.col("name"), titles))
    order = W.partitionBy("title").orderBy(F.length("name"), "file_path", "start_line", "id")
    hit = hit.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 3 * search_limit)
    brevity = F.greatest(F.lit(0.0), 10.0 - (F.length("name") - F.length("title")) / 3.0)
    best = hit.withColumn("score", 75.0 + kind_weight() + brevity + path_relevance(task.terms))
    return _arm(best.groupBy("id", "name", "file_path", "start_line").agg(F.max("score").alias("score")), "prefix")


def group_hits(task: Task) -> Column:
    """How many ideas of the text stand in a symbol's name, qualified name, path or signature."""
    hay = F.lower(F.concat_ws(" ", "name", "qualified_name", "file_path", F.coalesce("signature", F.lit(""))))
    total = F.lit(0)
    for group in task.groups:
        some = F.lit(False)
        for term in group:
            some = some | hay.contains(term)
        total = total + some.cast("int")
    return total


def compound_arm(nodes: DataFrame, task: Task, search_limit: int = 5) -> DataFrame:
    """Symbols that touch two ideas of the text or more."""
    hit = nodes.filter(~F.col("kind").isin(*LOW_VALUE)).withColumn("hits", group_hits(task)).filter("hits >= 2")
    brevity = F.greatest(F.lit(0.0), 10.0 - F.length("name") / 6.0)
    return _arm(_top(hit.withColumn("score", 70.0 + 24.0 * F.col("hits") + kind_weight() + path_relevance(task.terms) + brevity), search_limit), "compound")


def _file_scores(docs: DataFrame, task: Task, rank: Column | None) -> DataFrame:
    """Score of each text with words of the task in a window of 80 lines; without a rank as for texts not indexed."""
    near = window_hits(docs, "file_path", "content", list(task.terms)).withColumn("n", F.col("n_terms"))
    near = near if rank is None else near.join(docs.select("file_path", "rank"), "file_path")
    close = 18 * (F.col("n") - 1) + 3 * F.greatest(F.col("density") - F.col("n"), F.lit(0))
    base = path_relevance(task.terms) + close + (20 if rank is None else 22) * F.col("n")
    return near.select("file_path", (base if rank is None else 40 + rank + base).cast("double").alias("file_score"), "n", "matched", "hit_lines")


def content_files(contents: DataFrame, task: Task, search_limit: int = 5) -> DataFrame:
    """(file_path, file_score, n, matched, hit_lines) of the best files by their text: BM25 over all words of the task, then
    how near its search words stand. Only if no file comes of that, every text that holds a search word takes part."""
    docs = contents.filter(F.col("path").isNotNull()).groupBy(F.col("path").alias("file_path")).agg(F.max("content").alias("content"))
    st = Staging(contents.sparkSession, "content")
    ranked = bm25(docs, "file_path", "content", match_terms(task.text)).orderBy(F.desc("score"), "file_path").limit(4 * search_limit)
    ranked = st.put(ranked.withColumnRenamed("score", "rank"), "ranked")
    found = st.put(_file_scores(st.put(docs.join(F.broadcast(ranked), "file_path"), "texts"), task, F.col("rank")), "files")
    if found.isEmpty():
        found = st.put(_file_scores(docs, task, None), "all-files")
    return found.orderBy(F.desc("file_score"), F.desc("n"), "file_path").limit(3 * search_limit)


def _promoted(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaf, node the leaf stands in): the narrowest function, method, class, struct, interface or trait around its first line."""
    low = F.greatest("end_line", "start_line")
    around = nodes.filter(F.col("kind").isin("function", "method", "class", "struct", "interface", "trait"))
    around = around.select(
        "file_path", F.col("start_line").alias("s"), low.alias("e"), F.struct(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)), "start_line", "start_column", -F.col("end_line"), "id").alias("o"),
        F.struct("id", "name", "file_path", "start_line").alias("outer"),
    )
    pairs = leaves.select(F.col("id").alias("leaf"), "file_path", F.col("start_line").alias("at")).join(around, "file_path")
    pairs = pairs.filter((F.col("s") <= F.col("at")) & (F.col("e") >= F.col("at")) & (F.col("outer.id") != F.col("leaf")))
    return pairs.groupBy("leaf").agg(F.min_by("outer", "o").alias("outer"))


def content_arm(nodes: DataFrame, contents: DataFrame, task: Task, search_limit: int = 5, per_file: int = 5) -> DataFrame:
    """Symbols near the places in file texts (path, content) where the words of the task stand closest together, the best
    few per file; a variable or field stands for the function or type around it. Repeated paths count once."""
    if not task.terms:
        return _arm(nodes.filter(F.lit(False)).withColumn("score", F.lit(0.0)), "content")
    files = content_files(contents, task, search_limit)
    near = nodes.filter(~F.col("kind").isin(*LOW_VALUE)).join(F.broadcast(files), "file_path")
    hay = F.lower(F.concat_ws(" ", "name", "qualified_name", "file_path", F.coalesce("signature", F.lit(""))))
    hits = F.lit(0)
    for i, term in enumerate(task.terms):
        hits = hits + F.get("matched", F.lit(i)) * hay.contains(term).cast("int")
    end = F.greatest("end_line", "start_line")
    distance = F.array_min(F.transform("hit_lines", lambda at: F.greatest(F.col("start_line") - at, at - end, F.lit(0))))
    place = F.when(distance == 0, 35).when(distance <= 5, 24).when(distance <= 25, 12).otherwise(0)
    near = near.withColumn("node_hits", hits)
    score = 38.0 + F.col("file_score") + kind_weight() + lookup(IMPLEMENTATION_BIAS, F.col("kind"), 0) + 18 * F.col("node_hits") + place
    if not task.about_tests:
        score = F.when(is_test_file(F.col("file_path")), score * 0.35).otherwise(score)
    near = near.withColumn("score", F.round(score, 6))
    order = W.partitionBy("file_path").orderBy(F.desc("score"), F.desc("node_hits"))
    near = near.withColumn("_r", F.rank().over(order)).filter(F.col("_r") <= per_file)  # rank: those that tie are told apart below
    near = Staging(nodes.sparkSession, "near").put(near, "nodes")
    leaves = near.filter(F.col("kind").isin("variable", "field", "property"))
    wide = near.join(_promoted(leaves, nodes).withColumnRenamed("leaf", "id"), "id", "left")
    wide = wide.withColumn("outer", F.coalesce("outer", F.struct("id", "name", "file_path", "start_line")))
    order = order.orderBy(F.desc("score"), F.desc("node_hits"), "outer.start_line", "start_line", "start_column", F.desc("end_line"), "id")
    top = wide.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_file)
    return _arm(top.groupBy("outer").agg(F.max("score").alias("score")).select("outer.*", "score"), "content")


def fuse(arms: list[DataFrame]) -> DataFrame:
    """Best score of each symbol over all searches, with the search it came from."""
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    best = out.groupBy("id").agg(F.max(F.struct("score", "arm", "name", "file_path", "start_line")).alias("b"))
    return best.select("id", "b.name", "b.file_path", "b.start_line", "b.score", "b.arm")


def hybrid_search(nodes: DataFrame, file_contents: DataFrame, text: str, search_limit: int = 5, max_nodes: int = 20) -> DataFrame:
    """Top symbols for a task by their names and by the text of their files. Symbols of several ideas gain, those of one idea or none lose; a file that
    holds several named symbols lifts them."""
    task = Task.of(text)
    needed = ["id", "kind", "name", "qualified_name", "file_path", "signature", "start_line", "end_line", "start_column"]
    nodes = Staging(nodes.sparkSession, "named").put(nodes.select(*needed), "nodes")  # read by every arm
    named = [exact_arm(nodes, task), like_arm(nodes, task, search_limit), prefix_arm(nodes, task, search_limit), compound_arm(nodes, task, search_limit)]
    fused = fuse([*named, content_arm(nodes, file_contents, task, search_limit)])
    wide = fused.join(nodes.select("id", "qualified_name", "signature"), "id").withColumn("hits", group_hits(task))
    if len(task.groups) >= 2:
        wide = wide.withColumn("score", F.when(F.col("hits") >= 2, F.col("score") * (1 + 0.35 * F.col("hits"))).otherwise(F.col("score") * 0.62))
    if task.symbols:
        low = [s.lower() for s in task.symbols]
        named = wide.filter(F.lower("name").isin(*low)).groupBy("file_path").agg(F.countDistinct(F.lower("name")).alias("k"))
        wide = wide.join(named, "file_path", "left").withColumn("score", F.col("score") + F.when(F.col("k") >= 2, 20 * (F.col("k") - 1)).otherwise(0))
    return (
        wide.withColumn("score", F.round("score", 4))
        .orderBy(F.desc("score"), "id")
        .limit(max(max_nodes, search_limit))
        .select("id", "name", "file_path", "start_line", "score", "arm")
    )


def diversity_cap(ranked: DataFrame, total: int, share: float = 0.2, least: int = 5) -> DataFrame:
    """At most max(least, share of total) symbols of one file, best first."""
    cap = max(least, -(-int(total * share * 100) // 100))
    spot = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("spot", spot).filter(F.col("spot") <= cap).drop("spot")


def non_prod_cap(ranked: DataFrame, total: int, share: float = 0.15, least: int = 3) -> DataFrame:
    """At most max(least, share of total) symbols from tests, samples and mocks."""
    cap = max(least, -(-int(total * share * 100) // 100))
    flagged = ranked.withColumn("np", is_non_prod(F.col("file_path")))
    few = flagged.filter("np").orderBy(F.desc("score"), "id").limit(cap)
    return flagged.filter(~F.col("np")).unionByName(few).drop("np")
