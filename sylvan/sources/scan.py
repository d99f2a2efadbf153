"""Source trees and build databases as DataFrames."""

from __future__ import annotations

import json
import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.columns import language_of, skipped_path

MAX_BYTES = 20_000_000


def ignore_patterns(root: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[str, str, bool]]:
    """(folder, pattern, negated) of the ignore files under a local root, outer ones first."""
    out = []
    for folder, _, files in os.walk(root):
        for name in names:
            if name in files:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    for row in f.read().splitlines():
                        row = row.strip()
                        if row and not row.startswith("#"):
                            negated = row.startswith("!")
                            out.append((os.path.relpath(folder, root).replace(os.sep, "/"), row.lstrip("!"), negated))
    return out


def rule_pattern(folder: str, rule: str) -> str:
    """The paths an ignore rule covers, as a pattern that Python and the JVM read alike."""
    base = "" if folder == "." else re.escape(folder + "/")
    only_dirs, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    body, i = [], 0
    rule = rule.strip("/")
    while i < len(rule):
        c = rule[i]
        end = rule.find("]", i + 2)
        if rule.startswith("**/", i):
            body.append("(?:.*/)?")
            i += 2
        elif rule.startswith("**", i):
            body.append(".*")
            i += 1
        elif c == "*":
            body.append("[^/]*")
        elif c == "?":
            body.append("[^/]")
        elif c == "[" and end > 0:
            inside = rule[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            body.append("[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]")
            i = end
        else:
            body.append(re.escape(c))
        i += 1
    return f"^{base}{'' if anchored else '(?:.*/)?'}{''.join(body)}{'/' if only_dirs else '(?:/|$)'}"


def rule_runs(patterns: list[tuple[str, str, bool]]) -> list[tuple[str, bool]]:
    """Ignore rules in order, neighbours that decide alike as one pattern."""
    runs: list[tuple[str, bool]] = []
    for folder, rule, negated in patterns:
        one = rule_pattern(folder, rule)
        if runs and runs[-1][1] == negated:
            runs[-1] = (f"{runs[-1][0]}|{one}", negated)
        else:
            runs.append((one, negated))
    return runs


def ignored(path: str, patterns: list[tuple[str, str, bool]]) -> bool:
    """Whether a relative path falls under the ignore rules; the last rule that fits decides."""
    verdict = False
    for pattern, negated in rule_runs(patterns):
        if re.search(pattern, path):
            verdict = not negated
    return verdict


def ignored_path(path: Column, patterns: list[tuple[str, str, bool]]) -> Column:
    """``ignored`` as an expression."""
    verdict = F.lit(False)
    for pattern, negated in rule_runs(patterns):
        verdict = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return verdict


def scan_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, language, size, modified_at) of the source files below a folder.

    Files are listed and read by Spark; ignored, skipped, over-long and unknown files drop out before their
    bytes are decoded. Bytes that are no UTF-8 become the replacement character."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = F.lit(len(posixpath.join(os.path.abspath(base) if "://" not in base else re.sub(r"^\w+://[^/]*", "", base), "")) + 1)
    path = F.substr(F.regexp_replace("path", r"^\w+:/*", "/"), prefix)
    files = raw.select(path.alias("path"), "length", "modificationTime", "content").filter((F.col("length") <= max_bytes) & ~skipped_path(F.col("path")))
    rules = ignore_patterns(base) if "://" not in base else []
    if rules:
        files = files.filter(~ignored_path(F.col("path"), rules))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = files.withColumn("text", text)
    return files.select(
        "path",
        F.col("text").alias("content"),
        language_of(F.col("path"), F.col("text")).alias("language"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified_at"),
    ).filter(F.col("language").isNotNull())


def split_command(command: str) -> list[str]:
    """Words of a shell command: both quotes, and a backslash takes the next character even inside quotes."""
    out, word, quote, open_ = [], [], "", False
    i = 0
    while i < len(command):
        c = command[i]
        if c == "\\" and i + 1 < len(command):
            word.append(command[i + 1])
            open_ = True
            i += 1
        elif quote:
            if c == quote:
                quote = ""
            else:
                word.append(c)
        elif c in "'\"":
            quote, open_ = c, True
        elif c.isspace():
            if open_ or word:
                out.append("".join(word))
            word, open_ = [], False
        else:
            word.append(c)
        i += 1
    if open_ or word:
        out.append("".join(word))
    return out


def include_dirs(arguments: list[str], directory: str, root: str = "") -> list[str]:
    """Include folders of a compiler call: absolute, normalized, distinct, sorted, relative to ``root`` where below it."""
    found, i = [], 0
    while i < len(arguments):
        a = arguments[i]
        if a in ("-I", "/I", "-isystem", "-iquote") and i + 1 < len(arguments):
            found.append(arguments[i + 1])
            i += 1
        else:
            m = re.match(r"(?:-I|/I|-isystem|-iquote)(.+)", a)
            if m:
                found.append(m[1])
        i += 1
    whole = sorted({posixpath.normpath(posixpath.join(directory.replace("\\", "/"), f.replace("\\", "/"))) for f in found})
    base = root.rstrip("/") + "/" if root else ""
    return [w[len(base) :] if base and w.startswith(base) else w for w in whole]


def compile_units(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file_path, directory, include_dirs) of a compile_commands.json, all relative to ``root`` where below it."""
    schema = "directory string, file string, command string, arguments array<string>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)

    def dirs(directory, command, arguments):
        return include_dirs(list(arguments) if arguments else split_command(command or ""), directory or "", root)

    unit = F.udf(dirs, T.ArrayType(T.StringType()))
    file = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    base = root.rstrip("/") + "/" if root else ""
    relative = F.when(file.startswith(base), F.substr(file, F.lit(len(base) + 1))).otherwise(file) if base else file
    inside = F.when(F.concat("directory", F.lit("/")).startswith(base), F.substr("directory", F.lit(len(base) + 1))).otherwise(F.col("directory")) if base else F.col("directory")
    return raw.select(relative.alias("file_path"), inside.alias("directory"), unit("directory", "command", "arguments").alias("include_dirs"))


def find_compile_commands(root: str) -> str | None:
    for name in ("compile_commands.json", "build/compile_commands.json"):
        if os.path.exists(os.path.join(root, name)):
            return os.path.join(root, name)
    return None


def load_units(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
