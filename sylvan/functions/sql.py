"""The engine's functions under SQL names: scalar functions as expressions, extraction as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sylvan.functions.terms import STOP_WORDS
from sylvan.operators.resolve import C_FAMILY, C_PREFIXES, NAMES

EXTRACTED = "kind string, name string, qualified_name string, start_line int, end_line int, signature string"


@udtf(returnType=EXTRACTED)
class ExtractSymbols:
    """extract_symbols(path, language, content): the symbols of one source text."""

    def eval(self, path: str, language: str, content: str):
        from sylvan.extract.run import extract_file

        for s in extract_file(path or "", language or "", content or "").symbols:
            yield s.kind, s.name, s.qualified_name, s.start_line, s.end_line, s.signature


def _text(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


def register(spark: SparkSession) -> list[str]:
    """Registers wildcard_match, split_identifier, node_id, builtin_symbol and the table function extract_symbols
    in a session; all but the last are expressions that Catalyst inlines. Null arguments give null."""
    languages = " ".join(f"WHEN '{language}' THEN symbol IN ({_text(names)})" for language, names in NAMES.items())
    prefixes = " OR ".join(f"startswith(symbol, '{p}')" for p in C_PREFIXES)
    functions = {
        "wildcard_match": (
            "name STRING, pattern STRING",
            "BOOLEAN",
            "name ILIKE replace(CASE WHEN pattern RLIKE '[*?%_]' THEN replace(replace(pattern, '*', '%'), '?', '_') ELSE concat(pattern, '%') END, '\\\\', '\\\\\\\\')",
        ),
        "split_identifier": (
            "name STRING",
            "ARRAY<STRING>",
            "filter(split(lower(regexp_replace(regexp_replace(regexp_replace(name, '[_.-]', ' '), '([A-Z]+)([A-Z][a-z])', '$1 $2'), '([a-z0-9])([A-Z])', '$1 $2')), ' +'), "
            f"p -> length(p) >= 3 AND NOT p IN ({_text(STOP_WORDS)}))",
        ),
        "node_id": ("path STRING, kind STRING, name STRING, line INT", "STRING", "substring(sha2(concat(path, ':', kind, ':', name, ':', cast(line AS STRING)), 256), 1, 16)"),
        "builtin_symbol": (
            "symbol STRING, language STRING",
            "BOOLEAN",
            f"CASE language {languages} ELSE false END OR (language IN ({_text(C_FAMILY)}) AND ({prefixes}))",
        ),
    }
    for name, (arguments, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("extract_symbols", ExtractSymbols)
    return [*functions, "extract_symbols"]
