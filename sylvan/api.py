"""The engine: a snapshot of nodes, edges, files, contents and unresolved references, and what to ask it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan import tables
from sylvan.extract.run import extract_rows, links_of, nodes_of, unresolved_of
from sylvan.functions.columns import language_of, skipped_path
from sylvan.functions.terms import identifier_at, parse_query
from sylvan.operators import context, export, graph, resolve, search, sync, text_search
from sylvan.staging import Staging

def _present(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value) of a snapshot's metadata as last written; deleted keys are gone."""
    path = f"{folder}/project_metadata.parquet"
    rows = spark.read.schema(tables.METADATA).parquet(path) if _present(spark, path) else spark.createDataFrame([], tables.METADATA)
    return tables.latest(rows, "key", "updated_at").filter(F.col("value").isNotNull()).select("key", "value")


def put_metadata(spark: SparkSession, folder: str, values: dict[str, str | None]) -> None:
    """Writes keys, or deletes those whose value is None: rows are appended, the newest of a key counts."""
    now = time.time_ns() // 1000
    rows = spark.createDataFrame([(k, v, now) for k, v in values.items()], tables.METADATA)
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/project_metadata.parquet")


TABLES = ("nodes", "edges", "files", "file_contents", "unresolved_refs")


@dataclass
class Engine:
    """All answers are DataFrames; nothing is collected except the symbol a name is bound to."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    file_contents: DataFrame
    unresolved_refs: DataFrame

    # -- building ---------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Engine:
        """A snapshot kept as Parquet tables; repeated and older rows of a key are set aside."""
        t = {name: tables.conformed(tables.read(spark, folder, name), tables.SCHEMAS[name]) for name in TABLES}
        return cls(spark, tables.current_nodes(t["nodes"]), t["edges"], tables.current_files(t["files"]), t["file_contents"], t["unresolved_refs"])

    @classmethod
    def init(cls, spark: SparkSession, folder: str) -> Engine:
        """An empty snapshot in a folder; one that is there already stays as it is."""
        if not _present(spark, f"{folder}/nodes.parquet"):
            for name, schema in tables.SCHEMAS.items():
                spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}.parquet")
            put_metadata(spark, folder, {"schema_version": str(tables.VERSION)})
        return cls.open(spark, folder)

    @classmethod
    def update(cls, spark: SparkSession, folder: str, sources: DataFrame, force: bool = False) -> Engine:
        """The snapshot of a folder brought up to date with a scan: changed files only, or all of them with ``force``
        or where there is none. The caller saves it, beside the old one."""
        if force or not _present(spark, f"{folder}/nodes.parquet"):
            return cls.index(spark, sources)
        return cls.open(spark, folder).sync(sources)

    @classmethod
    def index(cls, spark: SparkSession, sources: DataFrame, resolve_refs: bool = True, units: DataFrame | None = None, progress: Callable[[str, dict[str, int]], None] | None = None) -> Engine:
        """Extracts (path, content, language[, size, modified_at]) into a new snapshot and resolves references, with
        the ``units`` of a build database if there is one. ``progress`` hears of each stage and what it counted."""
        st = Staging(spark, "index")
        rows, seen = st.put_counted(extract_rows(sources), "rows", symbols=F.sum(F.col("node").isNotNull().cast("long")), links=F.sum(F.col("link").isNotNull().cast("long")))
        if progress:
            progress("extracted", seen)
        nodes = nodes_of(rows)
        order = F.monotonically_increasing_id()
        edges = st.put(links_of(rows).drop("file_path").withColumn("edge_seq", order).select("edge_seq", "source", "target", "kind", "metadata", "line", "col", "provenance"), "edges")
        status = [F.lit(None).cast(t).alias(n) for n, t in (("candidates", "array<string>"), ("resolution_status", "string"), ("resolution_reason", "string"), ("resolution_attempted_at", "bigint"))]
        refs = st.put(unresolved_of(rows).withColumn("ref_seq", order).select("ref_seq", "from_node_id", "reference_name", "reference_kind", "line", "col", "file_path", "language", *status), "refs")
        size = F.col("size") if "size" in sources.columns else F.octet_length("content").cast("bigint")
        mtime = F.col("modified_at") if "modified_at" in sources.columns else F.lit(0).cast("bigint")
        counts = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("node_count"))
        files = sources.select("path", F.sha2("content", 256).alias("content_hash"), "language", size.alias("size"), mtime.alias("modified_at"), F.unix_millis(F.current_timestamp()).alias("indexed_at"))
        files = files.join(counts, "path", "left").fillna(0, ["node_count"]).withColumn("errors", F.lit(None).cast("array<string>"))
        engine = cls(spark, nodes, edges, files, sources.select("path", "content"), refs)
        if not resolve_refs:
            return engine
        done = engine.resolve(units)
        if progress:
            progress("resolved", {})
        return done

    def resolve(self, units: DataFrame | None = None, paths: DataFrame | None = None) -> Engine:
        """Points edges at the nodes their names resolve to and takes the resolved references off the queue; with
        ``paths`` (column path) only those of these files."""
        st = Staging(self.spark, "resolve")
        links = resolve.include_closure(resolve.imported_files(self.nodes, self.files, units))
        refs = self.unresolved_refs if paths is None else resolve.pending_of(self.unresolved_refs, paths)
        done = st.put(resolve.resolve_groups(refs, self.nodes, links, units=units), "groups")
        edges = st.put(resolve.retarget_edges(self.edges, self.nodes, done), "edges")
        key = ["reference_name", "reference_kind", "file_path", "language"]
        closed = done.filter(F.col("node_id").isNotNull() | (F.col("reason") == "external_builtin")).select(*key)
        left = self.unresolved_refs.join(closed, key, "left_anti")
        why = done.filter(F.col("node_id").isNull()).select(*key, F.col("reason").alias("_why"))
        left = left.join(why, key, "left").withColumn("resolution_reason", F.coalesce("_why", "resolution_reason")).withColumn(
            "resolution_status", F.when(F.col("_why").isNotNull(), "attempted").otherwise(F.col("resolution_status"))
        )
        return Engine(self.spark, self.nodes, edges, self.files, self.file_contents, left.drop("_why"))

    def save(self, folder: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def sync(self, sources: DataFrame) -> Engine:
        """The snapshot brought up to date with a scan: files that are gone or changed are replaced, the others'
        rows stay as they are, and edges into changed files are queued again by name."""
        state = Staging(self.spark, "sync").put(sync.classify(self.files, sync.scan_rows(sources)), "state")
        return self._apply(state, sources)

    def sync_file(self, path: str, content: str | None, language: str | None = None) -> Engine:
        """The snapshot with one file as it is now; None for a file that is gone. Nothing is done where the content is
        the stored one; a path that is never indexed counts as gone."""
        one = self.spark.createDataFrame([(path, content, language)], "path string, content string, language string")
        one = one.withColumn("language", F.coalesce("language", language_of(F.col("path"), F.col("content"))))
        one = one.filter(F.col("content").isNotNull() & F.col("language").isNotNull() & ~skipped_path(F.col("path")))
        stored = self.files.filter(F.col("path") == path)
        state = Staging(self.spark, "sync-file").put(sync.classify(stored, sync.scan_rows(one)), "state")
        return self if state.filter(F.col("state") != "unchanged").isEmpty() else self._apply(state, one)

    def _apply(self, state: DataFrame, sources: DataFrame) -> Engine:
        st = Staging(self.spark, "sync")
        stale = state.filter(F.col("state").isin("deleted", "changed")).select("path")
        fresh = sources.join(state.filter(F.col("state").isin("added", "changed")).select("path"), "path", "left_semi")
        new = Engine.index(self.spark, fresh, resolve_refs=False)
        queued = sync.requeue_incoming(self.edges, self.nodes, stale)
        nodes, edges = sync.remove_files(self.nodes, self.edges, stale)
        edges = edges.unionByName(sync.reopen_incoming(self.edges, self.nodes, stale))
        lost = stale.select(F.col("path").alias("file_path"))
        refs = self.unresolved_refs.join(lost, "file_path", "left_anti").unionByName(new.unresolved_refs).unionByName(queued, allowMissingColumns=True)
        out = Engine(
            self.spark,
            st.put(nodes.unionByName(new.nodes), "nodes"),
            st.put(edges.unionByName(new.edges), "edges"),
            st.put(self.files.join(stale, "path", "left_anti").unionByName(new.files), "files"),
            st.put(self.file_contents.join(stale, "path", "left_anti").unionByName(new.file_contents), "contents"),
            st.put(refs, "refs"),
        )
        return out.resolve()

    # -- lookups ----------------------------------------------------------
    def file(self, path: str) -> DataFrame:
        return self.files.filter(F.col("path") == path)

    def list_files(self, language: str | None = None) -> DataFrame:
        some = self.files if language is None else self.files.filter(F.col("language") == language)
        return some.orderBy("path")

    def nodes_of_kind(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind)

    def edges_of_kind(self, kind: str) -> DataFrame:
        return self.edges.filter(F.col("kind") == kind)

    def edges_of(self, node_id: str) -> DataFrame:
        """Edges at either end of a node; where there are none, those at its name."""
        found = graph.edges_for_nodes(self.node(node_id), self.edges).select("edge_seq", "found_by")
        return self.edges.join(F.broadcast(found), "edge_seq")

    def pending(self, path: str | None = None, name: str | None = None, limit: int = 1000) -> DataFrame:
        """Unresolved references waiting for resolution, of one file or one name."""
        some = self.unresolved_refs.filter(F.col("resolution_status").isNull())
        some = some if path is None else some.filter(F.col("file_path") == path)
        some = some if name is None else some.filter(F.col("reference_name") == name)
        return some.orderBy("ref_seq").limit(limit)

    # -- symbols ----------------------------------------------------------
    def search(self, pattern: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        return search.search_symbols(self.nodes, pattern, kind, limit)

    def find(self, query: str, limit: int = 20) -> DataFrame:
        """Search by words with ``kind:`` and ``file:`` filters: names that begin with the first word, of files whose
        path holds the filter and symbols that hold the other words."""
        kind, file, words = parse_query(query)
        some = self.nodes if file is None else self.nodes.filter(F.lower("file_path").contains(file.lower()))
        for w in words[1:]:
            some = some.filter(F.lower(F.concat_ws(" ", "name", "qualified_name", "signature")).contains(w.lower()))
        return search.search_symbols(some, words[0] if words else "", kind, limit)

    def definition(self, path: str, line: int, column: int) -> DataFrame:
        """Symbols that the identifier at a place (line from 1, column from 0) may mean, best first."""
        text = self.file_contents.filter(F.col("path") == path).select(F.get(F.split("content", "\n"), F.lit(line - 1)).alias("row")).first()
        name = identifier_at(text["row"] or "", column) if text else None
        wanted = self.spark.createDataFrame([(name,)], "name string").filter("name is not null")
        found = search.bind_names(self.nodes, wanted, candidates=50)
        return found.join(self.nodes.select("id", "name", "start_line", "end_line", "signature", "docstring"), "id").orderBy("rank")

    def bind(self, name: str, mode: str = "exact") -> str | None:
        """Id of the symbol a name means: an equal name or qualified name, else (or with mode search) the first hit."""
        if mode == "exact":
            one = self.spark.createDataFrame([(name,)], "name string")
            hit = search.bind_names(self.nodes, one).first()
            if hit is not None:
                return hit["id"]
        hit = search.search_symbols(self.nodes, name, None, 1).first()
        return None if hit is None else hit["id"]

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def document_symbols(self, path: str) -> DataFrame:
        own = self.nodes.filter(F.col("file_path") == path)
        return own.join(search.enclosing_parent(own), "id", "left").orderBy("start_line", "start_column", F.desc("end_line"))

    def symbol_at(self, path: str, line: int, col: int) -> DataFrame:
        return search.innermost_at(self.nodes, self.spark.createDataFrame([(path, line, col)], "file_path string, line int, col int"))

    def workspace_symbols(self, pattern: str) -> DataFrame:
        return search.workspace_symbols(self.nodes, pattern)

    # -- relations ----------------------------------------------------------
    def _edges_of(self, links: DataFrame, key: str, node_id: str | None, other: str, limit: int) -> DataFrame:
        hit = links.filter(F.col(key) == node_id) if node_id is not None else links.filter(F.lit(False))
        n = self.nodes.select(F.col("id").alias(other), "name", "kind", "file_path", "start_line")
        return hit.join(n, other).orderBy("file_path", "start_line", other).limit(limit)

    def callers(self, name: str, limit: int = 1000) -> DataFrame:
        return self._edges_of(graph.callers(self.nodes, self.edges), "id", self.bind(name), "caller_id", limit)

    def callees(self, name: str, limit: int = 1000) -> DataFrame:
        return self._edges_of(graph.callees(self.nodes, self.edges, by_name=True), "id", self.bind(name), "callee_id", limit)

    def references(self, name: str, limit: int = 1000) -> DataFrame:
        return self._edges_of(graph.references_to(self.nodes, self.edges), "id", self.bind(name), "referrer_id", limit)

    def uncalled(self, limit: int = 1000) -> DataFrame:
        return graph.uncalled_functions(self.nodes, self.edges).orderBy("file_path", "start_line", "id").limit(limit)

    def impact(self, name: str, depth: int = 2) -> DataFrame:
        start = self.spark.createDataFrame([(self.bind(name),)], "node string").filter("node is not null")
        reach = graph.impact_radius(self.nodes, self.edges, start, depth)
        return reach.join(self.nodes.select(F.col("id").alias("node"), "name", "file_path", "start_line"), "node").orderBy("file_path", "start_line", "node")

    def trace(self, source: str, target: str, max_hops: int = 33) -> list[str] | None:
        """Ids of a shortest call path; None if there is none. Only the path itself comes to the driver."""
        a, b = self.bind(source), self.bind(target)
        if a is None or b is None:
            return None
        by_id = graph.callees(self.nodes, self.edges).select(F.col("id").alias("source"), F.col("callee_id").alias("target"), F.lit("calls").alias("kind"))
        reach = Staging(self.spark, "trace").put(graph.shortest_paths(by_id, self.spark.createDataFrame([(a,)], "node string"), max_hops), "reach")
        path, at = [], b
        while at is not None:
            row = reach.filter(F.col("node") == at).first()
            if row is None:
                return None
            path.append(at)
            at = row["parent"]
        return path[::-1]

    # -- texts --------------------------------------------------------------
    def content_search(self, query: str, limit: int = 10) -> DataFrame:
        from sylvan.functions.terms import match_terms

        terms = match_terms(query)
        if not terms:
            return self.spark.createDataFrame([], "path string, score double")
        return text_search.bm25(self.file_contents, "path", "content", terms).orderBy(F.desc("score"), "path").limit(limit)

    def context(self, task: str, max_nodes: int = 20) -> DataFrame:
        """The symbols to show for a task, entry points first."""
        kept = context.context_nodes(self.nodes, self.edges, self.file_contents, task, max_nodes)
        return kept.orderBy(F.desc("is_root"), F.desc("score"), "start_line", "id")

    def build_context(self, task: str, max_nodes: int = 20, with_code: bool = True) -> context.Context:
        """Symbols, edges, call paths and code for a task: at most what is shown comes to the driver."""
        return context.build_context(self.nodes, self.edges, self.file_contents, task, self.files.count(), max_nodes, with_code)

    def context_markdown(self, task: str, max_nodes: int = 20, with_code: bool = True) -> str:
        return self.build_context(task, max_nodes, with_code).markdown()

    def context_json(self, task: str, max_nodes: int = 20, with_code: bool = True) -> str:
        return self.build_context(task, max_nodes, with_code).json()

    def explore(self, query: str, max_files: int = 0) -> str:
        """Symbols of a query by file with their source and the relations among them."""
        return context.explore(self.nodes, self.edges, self.file_contents, query, self.files.count(), max_files)

    def node_text_search(self, query: str, limit: int = 10) -> DataFrame:
        """Symbols by the words of their names, documentation and signatures, best first."""
        from sylvan.functions.terms import match_terms

        terms = match_terms(query)
        text = F.concat_ws(" ", "name", "qualified_name", F.coalesce("docstring", F.lit("")), F.coalesce("signature", F.lit("")))
        if not terms:
            return self.spark.createDataFrame([], "id string, score double")
        return text_search.bm25(self.nodes.select("id", text.alias("text")), "id", "text", terms).orderBy(F.desc("score"), "id").limit(limit)

    # -- whole snapshot -----------------------------------------------------
    def stats(self) -> DataFrame:
        parts = [("node_kind", self.nodes, "kind"), ("language", self.nodes, "language"), ("edge_kind", self.edges, "kind")]
        out = None
        for what, df, col in parts:
            part = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
            out = part if out is None else out.unionByName(part)
        return out

    def write_tags(self, path: str, one_file: bool = False) -> None:
        export.write_tags(self.nodes, path, one_file)
