"""Unresolved references: grouping, filtering and resolution across files in one pass over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvan.functions.columns import header_preference, is_header
from sylvan.functions.kinds import RESOLUTION_SCORE, lookup
from sylvan.staging import Staging

C_FAMILY = ("c", "cpp", "esqlc")
CALL_KINDS = ("calls", "instantiates")
# -- fixed values: names that belong to a language or its usual libraries, not to the project --------
C_PREFIXES = (
    "gtk_ Gtk gdk_ g_object_ g_signal_ g_list_ g_slist_ g_hash_table_ g_malloc g_free g_strdup Xt Xm CWnd:: CString:: GetWindow SetWindow ScreenToClient Exception JNI"
).split()
_PYTHON = """print len range str int float list dict set tuple bool type isinstance issubclass hasattr getattr setattr delattr callable repr abs all any bin bool bytes bytearray chr complex dir divmod enumerate
eval exec filter format frozenset globals hash help hex id input iter map max min next object oct open ord pow property round slice sorted sum super vars zip None True False Ellipsis NotImplemented append extend
pop insert remove sort reverse copy keys values items get update setdefault clear add remove discard union intersection difference join split strip lower upper replace find startswith endswith""".split()
_JS = """console window document process require module exports Promise Array Object String Number Boolean Function RegExp Date Error Math JSON Map Set WeakMap WeakSet Symbol Proxy Reflect Intl NaN Infinity undefined
parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent eval setTimeout setInterval clearTimeout clearInterval fetch await async let const class extends super this new typeof
instanceof void delete throw try catch finally if else for while do switch case break continue return with try Buffer URL URLSearchParams Headers Request Response""".split()
_GO = """make new len cap append copy delete panic recover print println error true false iota nil append cap close complex imag real fmt os io net http json encoding log sync context time math strings strconv bytes bufio""".split()
_RUST = """Some None Ok Err true false std core alloc vec string stringify println eprintln print eprint format panic unreachable unimplemented todo assert assert_eq assert_ne debug_assert debug_assert_eq
debug_assert_ne derive macro_rules use pub mod crate self super Option Result Vec String Vec HashMap HashSet Box Rc Arc Cell RefCell Mutex RwLock Condvar Drop Clone Copy PartialEq PartialOrd Eq Ord Default Debug Display
Hash Borrow Into From Iterator IntoIterator Extend DoubleEndedIterator Future Async await yield""".split()
_ESQL = "varchar date mod count sum avg min max substr substring trim upper lower".split()
_SHELL = """cd echo export local readonly shift test true false printf read return source set unset trap type ulimit umask wait exit break continue eval exec grep egrep fgrep sed awk cat cut sort uniq find xargs rm mv cp
mkdir rmdir chmod chown ln pwd dirname basename head tail wc tr tee date sleep kill ps expr printf""".split()
#: the C library's best-known names; a project's full list (several hundred) is passed as ``names``
_C = """printf fprintf sprintf snprintf scanf sscanf puts fputs putchar getchar fgets malloc calloc realloc free memcpy memmove memset memcmp strcpy strncpy strcat strncat strcmp strncmp
strlen strchr strrchr strstr strtok strtol strtoul strtod strdup atoi atol atof abs exit abort atexit getenv setenv system qsort bsearch rand srand time clock difftime localtime gmtime
strftime fopen fclose fread fwrite fseek ftell fflush feof ferror perror open close read write lseek dup dup2 fork execv wait waitpid kill signal pipe socket bind listen accept connect
send recv select poll pthread_create pthread_join pthread_mutex_lock pthread_mutex_unlock setjmp longjmp assert isalpha isdigit isspace isalnum isupper islower toupper tolower""".split()
NAMES = {
    "python": _PYTHON,
    **dict.fromkeys(("javascript", "typescript", "tsx", "jsx"), _JS),
    "go": _GO,
    "rust": _RUST,
    **dict.fromkeys(("c", "cpp"), _C),
    "esqlc": _C + _ESQL,
    "shell": _SHELL,
}


def builtin_table(spark: SparkSession, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(language, name): at most a few hundred rows a language, given as a parameter."""
    rows = [(language, n) for language, own in (names or NAMES).items() for n in sorted(set(own))]
    return spark.createDataFrame(rows, "language string, name string")


def has_external_prefix(name: Column) -> Column:
    out = F.lit(False)
    for p in C_PREFIXES:
        out = out | name.startswith(p)
    return out


def flag_builtins(refs: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds is_builtin: the name belongs to the language (``names``, language -> names, instead of the usual
    ones) or, in the C family, starts like a known library."""
    table = builtin_table(refs.sparkSession, names).select(F.col("language").alias("b_language"), F.col("name").alias("b_name"))
    hit = (F.col("reference_name") == F.col("b_name")) & (F.col("language") == F.col("b_language"))
    out = refs.join(F.broadcast(table), hit, "left")  # a fixed table
    is_builtin = F.col("b_name").isNotNull() | (F.col("language").isin(*C_FAMILY) & has_external_prefix(F.col("reference_name")))
    return out.withColumn("is_builtin", is_builtin).drop("b_language", "b_name")


def macro_like(name: Column) -> Column:
    """A C name that is no symbol to go to: one letter, ``_MACRO``, ``_UPPER``, or upper case throughout."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^[^A-Za-z0-9_]+", ""), r"[^A-Za-z0-9_]+$", "")
    return (
        (F.length(bare) <= 1)
        | bare.endswith("_MACRO")
        | bare.rlike(r"^_[_A-Z0-9]*$")
        | (bare.rlike("[A-Z]") & ~bare.rlike("[a-z]"))
    )


def trackable(flagged: DataFrame) -> Column:
    """Whether a reference is worth resolving (over the columns of ``flag_builtins``)."""
    name, language = F.col("reference_name"), F.col("language")
    noise = language.isin(*C_FAMILY) & F.col("reference_kind").isin("calls", "references", "instantiates") & macro_like(name)
    shell = (language == "shell") & F.trim(name).startswith("$")
    return (name != "") & ~F.col("is_builtin") & ~shell & ~noise


def unresolved_groups(refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending references by name, kind, file and language, most frequent first."""
    out = (
        refs.filter(F.col("resolution_status").isNull())
        .groupBy("reference_name", "reference_kind", "file_path", "language")
        .agg(F.count("*").alias("n"))
    )
    if limit is None:
        return out
    return out.orderBy(F.desc("n"), "reference_name", "reference_kind", "file_path", "language").limit(limit)


def pending_of(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """Pending references from some files (column path)."""
    some = paths.select(F.col("path").alias("file_path")).distinct()
    return refs.filter(F.col("resolution_status").isNull()).join(some, "file_path", "left_semi")


def name_pieces(name: Column) -> Column:
    """A name, its parts at each of ``. : / \\``, and those with a capital first letter."""
    parts = F.concat(F.array(name), *[F.split(name, sep) for sep in (r"\.", ":", "/", r"\\")])
    parts = F.filter(F.array_distinct(parts), lambda p: p != "")
    capital = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.array_distinct(F.concat(parts, capital))


def possible_names(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct reference names of which some piece is the name of a node."""
    known = nodes.select(F.col("name").alias("piece")).filter(F.col("piece").isNotNull()).distinct()
    pieces = groups.select("reference_name").distinct().select("reference_name", F.explode(name_pieces(F.col("reference_name"))).alias("piece"))
    return pieces.join(known, "piece", "left_semi").select("reference_name").distinct()


def resolve_groups(refs: DataFrame, nodes: DataFrame, imported: DataFrame | None = None, candidates: int = 50, names: dict[str, list[str]] | None = None, units: DataFrame | None = None) -> DataFrame:
    """One row per pending group with the node it resolves to and the rule that decided, else the reason.

    Rules in order: builtin names are external; a symbol of that name in the same file; the only candidate
    by name or qualified name; in the C family a candidate of the build (``units``: file_path, directory,
    include_dirs of a build database; a file that is built, else one below an include folder of the
    referring file's unit; for calls now, for other references after the next rule); a candidate in an
    imported file (``imported``: file_path, target_path; the best one in the C family, else only if it is
    the only one; an included header gives way to an implementation elsewhere for calls); in the C family the better of the first two candidates if they
    differ; a candidate whose path starts with the folder of the reference; the candidate of the best kind
    unless two tie. All groups are decided at once: the rules look only at nodes, which resolution never
    changes. Candidates are ranked per distinct name, at most ``candidates`` each, before they meet groups.
    """
    groups = unresolved_groups(refs)
    flagged = flag_builtins(groups, names)
    possible = possible_names(groups, nodes).withColumn("possible", F.lit(True))
    base = flagged.join(possible, "reference_name", "left").withColumn("possible", F.coalesce("possible", F.lit(False)))

    same = nodes.groupBy(F.col("name").alias("s_name"), F.col("file_path").alias("s_path")).agg(
        F.min(F.struct("start_line", "start_column", "id")).alias("s")
    )
    same = same.select("s_name", "s_path", F.col("s.id").alias("same_id"))
    keys = F.array_distinct(
        F.array(F.struct(F.col("name").alias("key"), F.lit(0).alias("by")), F.struct(F.col("qualified_name").alias("key"), F.lit(1).alias("by")))
    )
    index = nodes.select("id", "name", "qualified_name", "kind", "file_path", "start_line", F.explode(keys).alias("k")).select("*", "k.key", "k.by").drop("k")
    index = index.filter(~((F.col("by") == 1) & (F.col("key") == F.col("name"))))
    spot = F.row_number().over(W.partitionBy("key").orderBy("by", F.length("qualified_name"), "file_path", "start_line", "id"))
    wanted = possible.select(F.col("reference_name").alias("key"))
    ranked = index.join(wanted, "key", "left_semi").withColumn("spot", spot).filter(F.col("spot") <= candidates)
    ranked = ranked.select(
        "key", "spot", "id", "kind", F.col("file_path").alias("c_path"), "start_line", lookup(RESOLUTION_SCORE, F.col("kind"), 2).alias("score")
    )

    gkey = ["reference_name", "reference_kind", "file_path", "language"]
    pairs = base.filter(F.col("possible") & ~F.col("is_builtin")).join(ranked, F.col("reference_name") == F.col("key"))
    if imported is None:
        pairs = pairs.withColumn("is_imported", F.lit(False))
    else:
        links = imported.select(F.col("file_path").alias("i_path"), F.col("target_path").alias("i_target"), F.lit(True).alias("is_imported")).distinct()
        pairs = pairs.join(links, (F.col("file_path") == F.col("i_path")) & (F.col("c_path") == F.col("i_target")), "left").withColumn(
            "is_imported", F.coalesce("is_imported", F.lit(False))
        )
    if units is None:
        pairs = pairs.withColumn("built", F.lit(False)).withColumn("dir_rank", F.lit(None).cast("int"))
    else:
        made = units.select(F.col("file_path").alias("u_path"), F.lit(True).alias("built")).distinct()
        own = units.groupBy(F.col("file_path").alias("o_path")).agg(F.min("include_dirs").alias("dirs"))
        pairs = pairs.join(made, F.col("c_path") == F.col("u_path"), "left").join(own, F.col("file_path") == F.col("o_path"), "left")
        below = F.array_position(F.transform("dirs", lambda d: F.col("c_path").startswith(d)), True)
        pairs = pairs.withColumn("built", F.coalesce("built", F.lit(False))).withColumn("dir_rank", F.when(below > 0, below.cast("int")))
    call = F.col("reference_kind").isin(*CALL_KINDS)
    implementation = F.col("kind").isin("function", "method") & ~is_header(F.col("c_path"))
    c_family = F.col("language").isin(*C_FAMILY)
    folder = F.regexp_replace(F.regexp_extract("file_path", r"^(.*)[/\\][^/\\]*$", 1), r"\\", "/")
    pairs = pairs.select(
        *gkey,
        "id",
        "spot",
        "score",
        "c_path",
        "start_line",
        "is_imported",
        implementation.alias("is_impl"),
        F.when(call & implementation, 0).otherwise(1).alias("impl_rank"),
        header_preference(F.col("c_path")).alias("header_rank"),
        ((folder != "") & F.col("c_path").startswith(folder)).alias("near"),
        (c_family & F.col("built")).alias("built"),
        F.when(c_family, F.col("dir_rank")).alias("dir_rank"),
    )
    order = F.struct("impl_rank", "header_rank", (-F.col("score")).alias("neg"), "c_path", "start_line", "id")
    usable = F.col("is_imported") & ~(c_family & call & F.col("some_impl") & ~F.col("is_impl"))
    some_impl = F.max("is_impl").over(W.partitionBy(*gkey))
    pairs = pairs.withColumn("some_impl", some_impl)
    solid = F.col("score") >= 5
    decided = pairs.groupBy(*gkey).agg(
        F.count("*").alias("n_candidates"),
        F.min("id").alias("only_id"),
        F.min(F.when(usable, order)).alias("best_import"),
        F.count(F.when(usable, 1)).alias("n_imported"),
        F.sort_array(F.collect_list(F.when(solid, order))).alias("c_order"),  # at most ``candidates`` entries
        F.min(F.when(F.col("near"), F.struct("spot", "id"))).alias("best_near"),
        F.min(F.when(F.col("built"), F.struct("spot", "id"))).alias("best_built"),
        F.min(F.when(F.col("dir_rank").isNotNull(), F.struct("dir_rank", "spot", "id"))).alias("best_below"),
        F.max("score").alias("top_score"),
        F.max_by(F.col("id"), F.struct("score", -F.col("spot"))).alias("top_id"),
        F.sort_array(F.collect_list("score"), False).alias("scores"),
    )
    first, second = F.get("c_order", F.lit(0)), F.get("c_order", F.lit(1))
    platform = F.when(
        second.isNull() | ~((first.impl_rank == second.impl_rank) & (first.header_rank == second.header_rank) & (first.neg == second.neg)), first.id
    )
    joined = base.join(same, (F.col("reference_name") == F.col("s_name")) & (F.col("file_path") == F.col("s_path")), "left").join(decided, gkey, "left")
    live = ~F.col("is_builtin") & F.col("possible")
    imports = F.when(c_family | (F.col("n_imported") == 1), F.col("best_import.id"))
    in_build = F.coalesce(F.col("best_built.id"), F.col("best_below.id"))
    unique_top = F.when(F.coalesce(F.get("scores", F.lit(1)), F.lit(-1)) != F.col("top_score"), F.col("top_id"))
    rules = [
        ("same_file", F.col("same_id")),
        ("only_candidate", F.when(F.col("n_candidates") == 1, F.col("only_id"))),
        ("build", F.when(call, in_build)),
        ("imported_file", imports),
        ("build", F.when(~call, in_build)),
        ("platform", F.when(c_family, platform)),
        ("same_folder", F.col("best_near.id")),
        ("kind", unique_top),
    ]
    node = F.coalesce(*[F.when(live, value) for _, value in rules])
    rule = F.coalesce(*[F.when(live & value.isNotNull(), F.lit(name)) for name, value in rules])
    member = F.col("language").isin(*C_FAMILY) & (F.col("reference_name").contains(".") | F.col("reference_name").contains("::"))
    reason = (
        F.when(F.col("is_builtin"), "external_builtin")
        .when(~F.col("possible"), "not_found")
        .when(member, "member_call_no_receiver_type")
        .when((F.col("language") == "cpp") & F.col("reference_name").rlike("^[A-Z]"), "framework_or_member_call")
        .otherwise("ambiguous_or_unresolved")
    )
    return joined.select(*gkey, "n", node.alias("node_id"), rule.alias("rule"), F.when(node.isNull(), reason).alias("reason"))


def retarget_edges(edges: DataFrame, nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges of a resolved file, name and kind point to the node found; provenance and metadata say so."""
    files = nodes.select(F.col("id").alias("n_id"), F.col("file_path").alias("n_path"))
    hits = resolved.filter(F.col("node_id").isNotNull()).select("reference_name", "reference_kind", F.col("file_path").alias("r_path"), "node_id", "n")
    out = edges.join(files, F.col("source") == F.col("n_id"), "left").join(
        hits, (F.col("target") == F.col("reference_name")) & (F.col("kind") == F.col("reference_kind")) & (F.col("n_path") == F.col("r_path")), "left"
    )
    done = F.col("node_id").isNotNull()
    extra = F.create_map(F.lit("resolvedBy"), F.lit("cross-file"), F.lit("referenceCount"), F.col("n").cast("string"))
    return out.select(
        "edge_seq",
        "source",
        F.coalesce("node_id", "target").alias("target"),
        "kind",
        F.when(done, extra).otherwise(F.col("metadata")).alias("metadata"),
        "line",
        "col",
        F.when(done, "tree-sitter+resolved-cross-file").otherwise(F.col("provenance")).alias("provenance"),
    )


def folded(path: Column) -> Column:
    """A path without ``./`` and with up to eight ``folder/../`` taken out."""
    bare = F.regexp_replace(path, r"(^|/)(?:\./)+", "$1")
    for _ in range(8):
        bare = F.regexp_replace(bare, r"(^|/)(?!\.\.?/)[^/]+/\.\./", "$1")
    return F.when(path.contains("./"), bare).otherwise(path)


def imported_files(nodes: DataFrame, files: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(file_path, target_path): files that the import symbols of a file may mean, by language and extension.

    A relative import starts in the file's own folder, a Python module's dots are folders, any other path is
    taken as it stands; with ``units`` of a build database an include is also looked for in the folder of its file
    (unless in angle brackets), the unit's folder and its include folders. Only paths in ``files`` count."""
    imports = nodes.filter(F.col("kind") == "import").select("file_path", "language", F.explode(F.array("name", "signature")).alias("text"))
    text = F.trim("text")
    quoted = F.coalesce(F.nullif(F.regexp_extract(text, r"[\"']([^\"']*)[\"'][^\"']*$", 1), F.lit("")), F.lit(None))
    python = F.regexp_replace(F.regexp_replace(text, r"^(?:from|import)\s+", ""), r"[\s,].*$", "")
    c_like = F.regexp_replace(F.regexp_replace(text, r"^#?\s*(?:include\s*)?[<\"' \t]*", ""), r"[>\"' \t;]*$", "")
    script = F.col("language").isin("javascript", "typescript", "jsx", "tsx")
    path = F.when(script, quoted).when(F.col("language") == "python", python).otherwise(c_like)
    found = imports.select("file_path", "language", path.alias("path")).filter(F.col("path").isNotNull() & (F.col("path") != "")).distinct()
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    base = (
        F.when(F.col("path").startswith("."), F.concat(folder, F.lit("/"), F.regexp_replace("path", r"^\./", "")))
        .when(F.col("language") == "python", F.replace("path", F.lit("."), F.lit("/")))
        .otherwise(F.col("path"))
    )
    endings = (
        F.when(script, F.array(*map(F.lit, ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"])))
        .when(F.col("language") == "python", F.array(*map(F.lit, ["", ".py", "/__init__.py"])))
        .when(F.col("language") == "rust", F.array(*map(F.lit, ["", ".rs", "/mod.rs"])))
        .when(F.col("language").isin(*C_FAMILY), F.array(*map(F.lit, ["", ".h", ".hpp", ".c", ".cpp"])))
        .otherwise(F.array(F.lit("")))
    )
    tries = found.select("file_path", folded(base).alias("base"), F.explode(endings).alias("ending")).select("file_path", F.concat("base", "ending").alias("target_path"))
    if units is not None:
        own = units.groupBy(F.col("file_path").alias("u_path")).agg(F.min("directory").alias("directory"), F.min("include_dirs").alias("dirs"))
        angled = imports.filter(text.contains("<")).select("file_path", path.alias("path"), F.lit(True).alias("angled")).distinct()
        include = found.filter(F.col("language").isin(*C_FAMILY)).join(angled, ["file_path", "path"], "left").join(own, F.col("file_path") == F.col("u_path"))
        bases = F.concat(F.when(F.col("angled").isNull(), F.array(folder)).otherwise(F.array().cast("array<string>")), F.array("directory"), "dirs")
        spots = include.select("file_path", "path", F.explode(F.filter(bases, lambda b: b.isNotNull())).alias("at"))
        joined = F.when((F.col("at") == "") | F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", F.regexp_replace("at", "/+$", ""), "path"))
        tries = tries.unionByName(spots.select("file_path", folded(joined).alias("target_path")))
    # a header is also found by its base name wherever it lies
    header = found.filter(F.col("language").isin(*C_FAMILY)).select("file_path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("h_name"))
    known = files.select(F.col("path").alias("target_path")).distinct()
    by_name = known.select("target_path", F.regexp_extract("target_path", r"([^/\\]+)$", 1).alias("h_name")).filter(is_header(F.col("target_path")))
    return tries.join(known, "target_path", "left_semi").select("file_path", "target_path").unionByName(
        header.join(by_name, "h_name").select("file_path", "target_path")
    ).distinct()


def include_closure(links: DataFrame, max_depth: int = 4) -> DataFrame:
    """(file_path, target_path, depth): direct imports (depth 0) and those reached through up to ``max_depth`` more."""
    st = Staging(links.sparkSession, "includes")
    links = st.put(links.select("file_path", "target_path").distinct(), "links")
    nxt = links.select(F.col("file_path").alias("mid"), F.col("target_path").alias("far"))
    reached = step = st.put(links.withColumn("depth", F.lit(0)), "depth-0")
    for depth in range(1, max_depth + 1):
        wide = step.join(nxt, F.col("target_path") == F.col("mid")).select("file_path", F.col("far").alias("target_path"), F.lit(depth).alias("depth"))
        step = st.put(wide.distinct().join(reached, ["file_path", "target_path"], "left_anti"), f"depth-{depth}")
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
    return reached


def local_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_seq, target_id): targets resolved within the file of the source, by qualified name or by a name
    that only one symbol of the file has."""
    at = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("s_path"))
    inside = edges.select("edge_seq", "source", "target").filter(F.col("target").isNotNull()).join(at, "source")
    qualified = nodes.groupBy(F.col("qualified_name").alias("q"), F.col("file_path").alias("q_path")).agg(F.min("id").alias("q_id"))
    named = nodes.groupBy(F.col("name").alias("m"), F.col("file_path").alias("m_path")).agg(F.count("*").alias("c"), F.min("id").alias("m_id")).filter("c = 1")
    out = inside.join(qualified, (F.col("target") == F.col("q")) & (F.col("s_path") == F.col("q_path")), "left").join(
        named, (F.col("target") == F.col("m")) & (F.col("s_path") == F.col("m_path")), "left"
    )
    return out.select("edge_seq", F.coalesce("q_id", "m_id").alias("target_id")).filter(F.col("target_id").isNotNull())
