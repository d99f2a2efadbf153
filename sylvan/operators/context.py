"""What to show for a task: entry points, their neighbours in the graph, the edges and call paths between what
is kept, and code within an output budget.

Everything is a join of the edges or texts with a set of at most some dozens of symbols, which is broadcast;
only the rows to be shown come to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.functions.columns import INFRASTRUCTURE, is_non_prod, is_test_file
from sylvan.functions.kinds import CODE_BLOCK_PRIORITY, ENTRY_PRIORITY, IMPLEMENTATION_BIAS, LOW_VALUE, WEIGHT, lookup
from sylvan.functions.terms import compact_reason, explore_terms
from sylvan.operators.graph import REFERENCE_KINDS, by_id_or_name
from sylvan.operators.hybrid import Task, group_hits, hybrid_search
from sylvan.operators.resolve import flag_builtins
from sylvan.operators.search import search_symbols
from sylvan.operators.text_search import line_clusters
from sylvan.staging import Staging

SHOWN = ["id", "name", "qualified_name", "kind", "language", "file_path", "start_line", "end_line", "signature"]
BETWEEN = ("calls", "references", "extends", "implements", "overrides")
# -- fixed values: library calls that say nothing about a project -------------------------------------
RUNTIME_NAMES = """abort atoi calloc close dup dup2 exit free fprintf fputs getenv longjmp malloc memcpy memmove memset open printf read realloc setenv setjmp snprintf sprintf strcat strcmp strcpy
strlen strncmp write CVal CVan MEfree NMgtAt STcompare STcopy STncmp""".split()
#: files in the project -> (characters of a context, code blocks at least, characters of a block)
CONTEXT_BUDGET = ((500, 16_000, 0, 1_400), (5_000, 24_000, 6, 1_800), (None, 32_000, 8, 2_000))
#: files in the project -> (characters, files, characters of a file, symbols named per file, lines between clusters)
EXPLORE_BUDGET = ((500, 18_000, 8, 3_800, 12, 8), (5_000, 28_000, 10, 6_500, 18, 12), (15_000, 35_000, 12, 7_000, 24, 16), (None, 38_000, 14, 7_000, 24, 16))


def budget_of(table: tuple, n_files: int) -> tuple:
    return next(row[1:] for row in table if row[0] is None or n_files < row[0])


# -- what a symbol tells ------------------------------------------------------------------------------
def overlap(terms: tuple[str, ...]) -> Column:
    """How many words of a task stand in a symbol's name, qualified name, path or signature."""
    hay = F.lower(F.concat_ws(" ", "name", "qualified_name", "file_path", F.coalesce("signature", F.lit(""))))
    total = F.lit(0)
    for t in terms:
        total = total + hay.contains(t).cast("int")
    return total


def infrastructure_name(name: Column) -> Column:
    return F.lower(name).rlike(INFRASTRUCTURE)


def with_low_information(nodes: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Adds low_information: a symbol without a word of the task that is a builtin, a runtime call, named like
    infrastructure, or declared in a header."""
    flagged = flag_builtins(nodes.withColumn("reference_name", F.col("name")))
    path = F.lower("file_path")
    header = (path.contains("/hdr/") | path.endswith(".h")) & F.col("kind").isin("function", "variable", "constant", "field")
    dull = F.col("is_builtin") | F.col("name").isin(*RUNTIME_NAMES) | infrastructure_name(F.col("name")) | header
    return flagged.withColumn("low_information", (overlap(terms) == 0) & F.coalesce(dull, F.lit(False))).drop("reference_name", "is_builtin")


# -- entry points -------------------------------------------------------------------------------------
def entry_points(ranked: DataFrame, nodes: DataFrame, task: Task, limit: int = 5) -> DataFrame:
    """The best few of a search result to start from: callables before types before values, strong hits before
    weak ones (one idea of several), no value whose function is there too, a few per file; what is missing is
    filled up in the same order."""
    wide = ranked.select("id", "score", "arm").join(nodes.select(*SHOWN), "id")
    weak = (group_hits(task) < 2) & (overlap(task.terms) < 2) if len(task.groups) >= 2 else F.lit(False)
    wide = wide.withColumn("weak", weak).withColumn("priority", lookup(ENTRY_PRIORITY, F.col("kind"), 1))
    outer = wide.filter("priority > 0").select(F.col("file_path").alias("o_path"), F.col("start_line").alias("o_start"), F.greatest("end_line", "start_line").alias("o_end"))
    inside = (F.col("file_path") == F.col("o_path")) & (F.col("o_start") <= F.col("start_line")) & (F.col("o_end") >= F.col("start_line"))
    leaf = wide.filter("priority <= 0").join(outer, inside, "left_semi").select("id", F.lit(True).alias("held"))
    wide = wide.join(leaf, "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    order = ["weak", F.desc("priority"), F.desc("score"), "start_line", "id"]
    spot = F.row_number().over(W.partitionBy("file_path", "held").orderBy(*order))
    wide = wide.withColumn("passed", F.col("held") | (spot > max(2, limit // 3)))
    return wide.orderBy("passed", *order).limit(limit).select(*SHOWN, "score", F.col("arm").alias("reason"))


# -- neighbours ---------------------------------------------------------------------------------------
def neighbours(some: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], side: str, limit: int) -> DataFrame:
    """(of, id): at most ``limit`` symbols per row of ``some`` (a small set with id and name) on one side of edges of
    some kinds (``in``: sources of edges into it by id or name; ``out``: symbols its edges name), first lines first."""
    links = edges.filter(F.col("kind").isin(*kinds)).select("source", "target", "line", "col")
    if side == "in":
        keys = F.broadcast(by_id_or_name(some).select("key", F.col("id").alias("of")))  # as small as ``some``
        found = links.join(keys, F.col("target") == F.col("key")).select("of", F.col("source").alias("id"), "line", "col")
        found = found.join(nodes.select("id"), "id", "left_semi")
    else:
        found = links.join(F.broadcast(some.select(F.col("id").alias("of"))), F.col("source") == F.col("of")).select("of", "target", "line", "col")
        found = found.join(by_id_or_name(nodes).select("key", "id"), F.col("target") == F.col("key"))
    found = found.groupBy("of", "id").agg(F.min(F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"))).alias("at"))
    spot = F.row_number().over(W.partitionBy("of").orderBy("at", "id"))
    return found.withColumn("spot", spot).filter(F.col("spot") <= limit).select("of", "id")


def expansion(roots: DataFrame, nodes: DataFrame, edges: DataFrame, task: Task, limit: int = 5, decay: float = 0.72) -> DataFrame:
    """(id, score, reason): callers, callees and referrers of the roots (id, name, score), scored by the root."""
    arms = [("caller", ("calls",), "in", limit), ("callee", ("calls",), "out", limit), ("reference", REFERENCE_KINDS, "in", limit // 2 + 1)]
    found = None
    for reason, kinds, side, n in arms:
        part = neighbours(roots, nodes, edges, kinds, side, n).withColumn("reason", F.lit(reason))
        found = part if found is None else found.unionByName(part)
    own = roots.select(F.col("id").alias("of"), F.col("score").alias("of_score"))
    is_root = roots.select("id", F.lit(25.0).alias("bonus"))
    wide = found.join(F.broadcast(own), "of").join(F.broadcast(is_root), "id", "left").join(nodes.select("id", "kind", "file_path"), "id")
    score = F.col("of_score") * decay + F.coalesce("bonus", F.lit(0.0)) + lookup(WEIGHT, F.col("kind"), 0)
    if not task.about_tests:
        score = F.when(is_test_file(F.col("file_path")), score * 0.35).otherwise(score)
    best = wide.withColumn("score", F.round(score, 6)).groupBy("id").agg(F.max(F.struct("score", "reason")).alias("b"))
    return best.select("id", "b.score", "b.reason")


def relationship_context(kept: DataFrame, nodes: DataFrame, edges: DataFrame, task: Task, sources: int = 12) -> DataFrame:
    """(id, score, reason): telling callees (80) and callers (40) of the first ``sources`` rows of kept (id, name,
    file_path, score, is_root). Often called and infrastructure symbols lose, those of the same file gain."""
    st = Staging(nodes.sparkSession, "related")
    first = st.put(kept.orderBy(F.desc("is_root"), F.desc("score"), "start_line", "id").limit(sources), "sources")
    out = neighbours(first, nodes, edges, ("calls",), "out", 80).withColumn("label", F.lit("callee"))
    into = neighbours(first, nodes, edges, ("calls",), "in", 40).withColumn("label", F.lit("caller"))
    pairs = out.unionByName(into).join(F.broadcast(kept.select("id")), "id", "left_anti")
    wide = pairs.join(nodes.select(*SHOWN), "id").filter(~F.col("kind").isin(*LOW_VALUE, "file"))
    wide = st.put(with_low_information(wide, task.terms).filter("NOT low_information").drop("low_information"), "pairs")  # at most 120 a source
    fan = neighbours(wide.select("id", "name").distinct(), nodes, edges, ("calls",), "in", 25).groupBy(F.col("of").alias("id")).agg(F.count("*").alias("fan_in"))
    own = first.select(F.col("id").alias("of"), F.col("name").alias("of_name"), F.col("file_path").alias("of_path"), F.col("score").alias("of_score"))
    wide = wide.join(F.broadcast(own), "of").join(F.broadcast(fan), "id", "left").withColumn("hits", overlap(task.terms))
    same = F.col("file_path") == F.col("of_path")
    noise = F.when(infrastructure_name(F.col("name")), 90.0).otherwise(0.0) + F.when(F.col("fan_in") >= 20, 55.0).when(F.col("fan_in") >= 10, 25.0).otherwise(0.0)
    score = F.col("of_score") * 0.58 + lookup(WEIGHT, F.col("kind"), 0) + lookup(IMPLEMENTATION_BIAS, F.col("kind"), 0) + F.col("hits") * 20.0
    score = score + F.when(same, 8.0).otherwise(0.0) - F.when((F.col("hits") > 0) | same, 0.0).otherwise(noise)
    best = wide.withColumn("score", F.round(score, 6)).filter("score > 0").withColumn("reason", F.concat("label", F.lit(" of "), "of_name"))
    return best.groupBy("id").agg(F.max(F.struct("score", "reason")).alias("b")).select("id", "b.score", "b.reason")


def capped(ranked: DataFrame, total: int, about_tests: bool) -> DataFrame:
    """Ranked rows (with is_root) without too many of one file or from tests and samples; roots always stay."""
    order = [F.desc("score"), "start_line", "id"]
    per_file = max(5, -(-total // 5))
    ranked = ranked.withColumn("spot", F.row_number().over(W.partitionBy("file_path").orderBy(*order))).filter(F.col("is_root") | (F.col("spot") <= per_file)).drop("spot")
    if about_tests:
        return ranked
    free = ~is_non_prod(F.col("file_path")) | F.col("is_root")
    few = ranked.filter(~free).orderBy(*order).limit(max(3, -(-total * 15 // 100)))
    return ranked.filter(free).unionByName(few)


def context_nodes(nodes: DataFrame, edges: DataFrame, file_contents: DataFrame, text: str, max_nodes: int = 20) -> DataFrame:
    """The symbols to show for a task, roots first by score: ``SHOWN``, score, reason, is_root. At most max_nodes rows."""
    task = Task.of(text)
    st = Staging(nodes.sparkSession, "context")
    nodes = st.put(nodes.select(*SHOWN, "start_column"), "nodes")
    limit = min(max(max_nodes, 1), 5)
    ranked = hybrid_search(nodes, file_contents, text, limit, max_nodes)
    roots = st.put(entry_points(ranked, nodes, task, limit), "roots")
    flag = roots.select("id", F.lit(True).alias("is_root"))
    scored = roots.select("id", "score", "reason").unionByName(expansion(roots, nodes, edges, task))
    scored = scored.groupBy("id").agg(F.max(F.struct("score", "reason")).alias("b")).select("id", "b.score", "b.reason")

    def filled(some: DataFrame) -> DataFrame:
        wide = some.join(nodes.select(*SHOWN), "id").join(F.broadcast(flag), "id", "left")
        return wide.withColumn("is_root", F.coalesce("is_root", F.lit(False))).select(*SHOWN, "score", "reason", "is_root")

    first = filled(scored).orderBy(F.desc("score"), "start_line", "id").limit(max_nodes)
    kept = with_low_information(capped(first, max_nodes, task.about_tests), task.terms).filter("is_root OR NOT low_information").drop("low_information")
    kept = st.put(kept.select(*SHOWN, "score", "reason", "is_root"), "kept")
    more = filled(relationship_context(kept, nodes, edges, task))
    return st.put(kept.unionByName(more).orderBy(F.desc("is_root"), F.desc("score"), "start_line", "id").limit(max_nodes), "shown")


def edges_between(kept: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = BETWEEN) -> DataFrame:
    """(source_id, target_id, kind, line): edges both ends of which are in a small set of symbols, by id or name."""
    keys = by_id_or_name(kept).groupBy("key").agg(F.min("id").alias("id"))
    a = F.broadcast(keys.select(F.col("key").alias("a_key"), F.col("id").alias("source_id")))
    b = F.broadcast(keys.select(F.col("key").alias("b_key"), F.col("id").alias("target_id")))
    hit = edges.filter(F.col("kind").isin(*kinds)).join(a, F.col("source") == F.col("a_key")).join(b, F.col("target") == F.col("b_key"))
    return hit.groupBy("source_id", "target_id", "kind").agg(F.min("line").alias("line"))


def call_paths(roots: list[str], calls: list[tuple[str, str]], longest: int = 6, fan_out: int = 4, shown: int = 3) -> list[list[str]]:
    """Chains of calls from a root that pass another root, longest first. The calls are those among the few
    symbols of a context."""
    ahead: dict[str, list[str]] = {}
    for a, b in calls:
        if b not in ahead.setdefault(a, []):
            ahead[a].append(b)
    found: list[tuple[str, ...]] = []
    walks = [(r,) for r in roots[:5] if r in ahead]
    while walks:
        walk = walks.pop()
        further = [] if len(walk) >= longest else [n for n in ahead.get(walk[-1], [])[:fan_out] if n not in walk]
        walks += [(*walk, n) for n in further]
        if not further and len(walk) >= 3 and len(set(walk) & set(roots)) >= 2:
            found.append(walk)
    return [list(w) for w in sorted(set(found), key=lambda w: (-len(w), w))[:shown]]


# -- code ---------------------------------------------------------------------------------------------
def block_end(lines: list[str], start: int, language: str) -> int:
    """Last line (from 1) of the block that begins at ``start``: by indentation in Python, else where the
    braces close, or at a semicolon before any brace."""
    if not 1 <= start <= len(lines):
        return start
    if language == "python":
        indent, end = len(lines[start - 1]) - len(lines[start - 1].lstrip()), start
        for n, row in enumerate(lines[start:], start + 1):
            if row.strip() and not row.lstrip().startswith("#") and len(row) - len(row.lstrip()) <= indent:
                break
            end = n
        return end
    depth, opened = 0, False
    for n, row in enumerate(lines[start - 1 :], start):
        opened = opened or "{" in row
        depth += row.count("{") - row.count("}")
        if opened and depth <= 0 or not opened and n > start and row.rstrip().endswith(";"):
            return n
    return start


def centred_slice(lines: list[str], start: int, end: int, terms: tuple[str, ...], focus: list[int], size: int) -> tuple[int, str]:
    """(first line, text) of at most about ``size`` characters of a block: all of it if it fits, else the lines
    around the one with most words of the task; lines near a ``focus`` line count a little."""
    whole = "\n".join(lines[start - 1 : end])
    if len(whole) <= size:
        return start, whole

    def worth(n: int) -> int:
        low = lines[n - 1].lower()
        near = max((8 - 2 * abs(n - f) for f in focus if abs(n - f) <= 2), default=0)
        return 10 * sum(t in low for t in terms) + near

    best = max(range(start, end + 1), key=lambda n: (worth(n), -n))
    if not worth(best):
        return start, whole
    low, high = max(start, best - 10), min(end, best + 10)
    while high - low >= 4 and len("\n".join(lines[low - 1 : high])) > size:
        if best - low > high - best:
            low += 1
        else:
            high -= 1
    return low, "\n".join(lines[low - 1 : high])


def limited(text: str, size: int) -> tuple[str, bool]:
    """Whole lines of a text up to a size, and whether some are missing."""
    if len(text) <= size:
        return text, False
    kept, used = [], 0
    for row in text.split("\n"):
        if used + len(row) + 1 > size:
            break
        kept.append(row)
        used += len(row) + 1
    return "\n".join([*kept, "", "// ... truncated ..."]), True


def trimmed(text: str, size: int, note: str = "\n\n... output truncated to context budget ...\n") -> str:
    return text if len(text) <= size else text[:size] + note


def code_block_order(kept: DataFrame) -> DataFrame:
    """Kept symbols in the order in which their code is shown, at most two of a file (column ``spot``)."""
    some = kept.filter(~F.col("kind").isin(*LOW_VALUE, "file")).withColumn("priority", lookup(CODE_BLOCK_PRIORITY, F.col("kind"), 1))
    order = [F.desc("priority"), F.desc("score"), "start_line", "id"]
    some = some.withColumn("in_file", F.row_number().over(W.partitionBy("file_path").orderBy(*order))).filter("in_file <= 2")
    return some.withColumn("spot", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).drop("in_file", "priority")  # a few dozen rows


@dataclass
class Context:
    """A context as rows on the driver: at most the symbols, edges and code blocks to be shown."""

    query: str
    nodes: list
    edges: list
    call_paths: list[list[str]]
    code: list[dict]
    max_chars: int

    def files(self) -> list[str]:
        return list(dict.fromkeys(n["file_path"] for n in self.nodes))

    def markdown(self) -> str:
        if not self.nodes:
            return "No relevant symbols found."
        roots = [n for n in self.nodes if n["is_root"]]
        rest = [n for n in self.nodes if not n["is_root"]]
        out = ["## Code Context", "", f"**Query:** {self.query}", ""]
        out += [f"**Summary:** {len(roots)} entry points, {len(rest)} related symbols, {len(self.edges)} edges, {len(self.files())} files", "", "### Entry Points", ""]
        for n in roots:
            out.append(f"- **{n['name']}** ({n['kind']}) - {n['file_path']}:{n['start_line']} _score {n['score']:.1f}, {n['reason']}_")
            if n["signature"]:
                out.append(f"  `{' '.join(n['signature'].split(chr(10)))}`")
        if rest:
            out += ["", "### Related Symbols", ""]
            by_file: dict[str, list[str]] = {}
            for n in rest[:12]:
                by_file.setdefault(n["file_path"], []).append(f"{n['name']}:{n['start_line']} [{compact_reason(n['reason'])}]")
            out += [f"- {path}: {', '.join(names)}" for path, names in sorted(by_file.items())]
        if self.call_paths:
            out += ["", "### Call Paths", "", *[f"- {' → '.join(p)}" for p in self.call_paths]]
        out += ["", "### Related Files", "", *[f"- {f}" for f in self.files()[:10]]]
        if len(self.files()) > 10:
            out.append(f"- ... and {len(self.files()) - 10} more")
        if self.code:
            out += ["", "### Code", ""]
            for b in self.code:
                out += [f"#### {b['name']} ({b['file_path']}:{b['start_line']})", "", f"```{b['language']}", b["content"], "```"]
                out += ["_Snippet truncated to context budget._", ""] if b["truncated"] else [""]
        return trimmed("\n".join(out) + "\n", self.max_chars)

    def json(self) -> str:
        nodes = [
            {"id": n["id"], "name": n["name"], "kind": n["kind"], "filePath": n["file_path"], "startLine": n["start_line"], "endLine": n["end_line"], "signature": n["signature"], "score": n["score"], "reason": n["reason"]}
            for n in self.nodes
        ]
        code = [{"nodeId": b["id"], "nodeName": b["name"], "filePath": b["file_path"], "startLine": b["start_line"], "endLine": b["end_line"], "language": b["language"], "content": b["content"], "truncated": b["truncated"]} for b in self.code]
        roots = [n["id"] for n in self.nodes if n["is_root"]]
        summary = {"entryPointCount": len(roots), "nodeCount": len(nodes), "edgeCount": len(self.edges), "fileCount": len(self.files()), "codeBlockCount": len(code)}
        edges = [{"source": e["source_id"], "target": e["target_id"], "kind": e["kind"], "line": e["line"]} for e in self.edges]
        return json.dumps({"query": self.query, "summary": summary, "entryPoints": roots, "nodes": nodes, "edges": edges, "relatedFiles": self.files(), "callPaths": self.call_paths, "codeBlocks": code}, indent=2, ensure_ascii=False)


def build_context(nodes: DataFrame, edges: DataFrame, file_contents: DataFrame, text: str, n_files: int, max_nodes: int = 20, with_code: bool = True) -> Context:
    """The whole context of a task within the budget of a project of ``n_files`` files."""
    max_chars, least, size = budget_of(CONTEXT_BUDGET, n_files)
    n_blocks = min(max(min(5, max_nodes), least), max_nodes)
    task = Task.of(text)
    kept = context_nodes(nodes, edges, file_contents, text, max_nodes)
    shown = kept.orderBy(F.desc("is_root"), F.desc("score"), "start_line", "id").collect()
    links = edges_between(kept, edges).orderBy("source_id", "target_id", "kind").collect()
    names = {n["id"]: n["name"] for n in shown}
    paths = call_paths([n["id"] for n in shown if n["is_root"]], [(e["source_id"], e["target_id"]) for e in links if e["kind"] == "calls"])
    code: list[dict] = []
    if with_code and shown:
        some = code_block_order(kept).filter(F.col("spot") <= n_blocks)
        texts = file_contents.select(F.col("path").alias("file_path"), "content").join(F.broadcast(some.select("file_path").distinct()), "file_path")
        texts = texts.groupBy("file_path").agg(F.max("content").alias("content"))
        for r in some.join(texts, "file_path").orderBy("spot").collect():  # at most n_blocks rows
            lines = (r["content"] or "").replace("\r\n", "\n").split("\n")
            start = max(r["start_line"] or 1, 1)
            end = max(min(max(r["end_line"] or start, block_end(lines, start, r["language"])), len(lines)), start)
            focus = [e["line"] for e in links if e["line"] and r["id"] in (e["source_id"], e["target_id"])]
            first, cut = centred_slice(lines, start, end, task.terms, focus, size)
            content, short = limited(cut, size)
            if content.strip():
                code.append({"id": r["id"], "name": r["name"], "file_path": r["file_path"], "language": r["language"], "start_line": first, "end_line": first + content.count("\n"), "content": content, "truncated": short})
    return Context(text, shown, links, [[names[i] for i in p] for p in paths], code, max_chars)


# -- explore ------------------------------------------------------------------------------------------
def explore_nodes(nodes: DataFrame, file_contents: DataFrame, query: str, limit: int = 64) -> DataFrame:
    """``SHOWN`` and ``place``: symbols whose names begin with the query, then with each of its words; where these
    are few, the first symbols of the files that hold the words most often. Every symbol once, at its first place."""
    st = Staging(nodes.sparkSession, "explore")
    slim = st.put(nodes.select(*SHOWN), "nodes")
    words = [w for w in explore_terms(query) if len(w) > 1]
    arms = [
        search_symbols(slim, pattern, None, limit).select("id", F.lit(i).alias("arm"), F.struct("rank", F.length("name").alias("n"), "file_path", "start_line", "id").alias("at"))
        for i, pattern in enumerate([query, *words])
    ]
    found = arms[0]
    for a in arms[1:]:
        found = found.unionByName(a)
    spot = F.row_number().over(W.partitionBy("arm").orderBy("at"))  # at most ``limit`` rows an arm
    found = st.put(found.select("id", "arm", spot.alias("nth")), "named")
    first = found.groupBy("id").agg(F.min(F.struct("arm", "nth")).alias("place"))
    if words and first.count() < min(limit, 8):
        low = F.lower(F.coalesce("content", F.lit("")))
        hits = sum((F.least(F.lit(5), F.size(F.split(low, F.lit(w), -1)) - 1) for w in words), F.lit(0))
        docs = file_contents.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max("content").alias("content"))
        files = docs.select(F.col("path").alias("file_path"), hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "file_path").limit(8)
        near = slim.join(F.broadcast(files), "file_path")
        order = W.partitionBy("file_path").orderBy("start_line", F.desc("end_line"), "id")
        near = near.withColumn("n", F.row_number().over(order)).filter("n <= 12")
        more = near.select("id", F.lit(len(words) + 1).alias("arm"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("hits"), "file_path", "n")).alias("nth"))
        first = found.unionByName(more).groupBy("id").agg(F.min(F.struct("arm", "nth")).alias("place"))
    return slim.join(F.broadcast(first.orderBy("place", "id").limit(limit)), "id")


def explore_relations(some: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, kind): names at both ends of calls and references within a small set of symbols, in order."""
    named = by_id_or_name(some).groupBy("key").agg(F.min("name").alias("name"))
    a = F.broadcast(named.select(F.col("key").alias("a_key"), F.col("name").alias("source_name")))
    b = F.broadcast(named.select(F.col("key").alias("b_key"), F.col("name").alias("target_name")))
    hit = edges.filter(F.col("kind").isin("calls", "references")).join(a, F.col("source") == F.col("a_key")).join(b, F.col("target") == F.col("b_key"))
    return hit.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "kind").distinct()


def symbols_by_file(some: DataFrame) -> DataFrame:
    """(file_path, symbols): the symbols of each file in order of their place."""
    entry = F.struct("start_line", "end_line", "name", "id")
    return some.groupBy("file_path").agg(F.sort_array(F.collect_list(entry)).alias("symbols"))  # of a bounded set


def within_budget(sections: DataFrame, size: str, order: list, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order while the sum of their sizes stays within the budget; ``by`` gives each group a budget of its own."""
    frame = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return sections.withColumn("used", F.sum(size).over(frame)).filter(F.col("used") <= budget)


def explore(nodes: DataFrame, edges: DataFrame, file_contents: DataFrame, query: str, n_files: int, max_files: int = 0) -> str:
    """Symbols of a query by file with the source around them and the relations among them, within a budget."""
    max_chars, most, per_file, in_head, gap = budget_of(EXPLORE_BUDGET, n_files)
    most = min(max_files, most) if max_files > 0 else most
    st = Staging(nodes.sparkSession, "explore")
    some = st.put(explore_nodes(nodes, file_contents, query, max(20, 8 * most)), "some")
    groups = symbols_by_file(some)
    texts = file_contents.select(F.col("path").alias("file_path"), "content").join(F.broadcast(groups.select("file_path")), "file_path")
    texts = texts.groupBy("file_path").agg(F.max("content").alias("content"))
    ranges = line_clusters(some, "file_path", 3, gap).groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line"))).alias("ranges"))
    rows = groups.join(texts, "file_path").join(ranges, "file_path").orderBy("file_path").limit(most).collect()  # at most 14 files
    if not some.take(1):
        return "No symbols found."
    out = [f"## Explore: `{query}`\n"]
    lines = [f"- {r['source']} → {r['target']} ({r['kind']})" for r in explore_relations(some, edges).orderBy("source", "target", "kind").limit(30).collect()]
    if lines:
        out += ["### Relationships\n", *lines, ""]
    out.append("### Source Code\n")
    used = sum(len(x) + 1 for x in out)
    for r in rows:
        text = (r["content"] or "").replace("\r\n", "\n").split("\n")
        head = ", ".join(f"{s['name']}:{s['start_line']}" for s in r["symbols"][:in_head])
        body = ""
        for k, c in enumerate(r["ranges"]):
            cut = "\n".join(f"{n}\t{text[n - 1]}" for n in range(c["start_line"], min(c["end_line"], len(text)) + 1))
            if len(body) + len(cut) > per_file:
                body += "\n⋮ trimmed to per-file budget ⋮\n"
                break
            body += ("\n⋮\n" if k else "") + cut
        if not body.strip():
            continue
        section = f"#### {r['file_path']} — {head}\n\n```\n{body.rstrip()}\n```\n"
        if used + len(section) > max_chars:
            out.append("⋮ explore output trimmed to budget ⋮")
            break
        out.append(section)
        used += len(section) + 1
    return trimmed("\n".join(out), max_chars, "\n\n⋮ explore output trimmed to budget ⋮\n")
