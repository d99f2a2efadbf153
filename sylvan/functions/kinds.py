"""Attributes of symbol kinds and languages, as one small table and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_KINDS = (
    "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export component"
).split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
LANGUAGES = "c cpp javascript typescript tsx jsx python go rust shell esqlc".split()

_CALLABLE, _SHAPES = ("function", "method"), ("class", "struct", "interface", "trait")
_VALUES = ("variable", "constant", "property", "field")
# -- fixed values: kind -> number or letter ---------------------------------------------------------
WEIGHT = (
    dict.fromkeys(_CALLABLE, 18) | dict.fromkeys((*_SHAPES, "protocol"), 15) | {"component": 14} | dict.fromkeys(("enum", "type_alias"), 12)
    | dict.fromkeys(("module", "namespace"), 8) | dict.fromkeys(_VALUES, 5) | {"file": 3}
)
IMPLEMENTATION_BIAS = dict.fromkeys(_CALLABLE, 18) | dict.fromkeys(_SHAPES, 8) | dict.fromkeys(("variable", "field", "property", "parameter"), -10)
ENTRY_PRIORITY = (
    dict.fromkeys(NODE_KINDS, 1) | dict.fromkeys(_CALLABLE, 4) | dict.fromkeys(_SHAPES, 3) | dict.fromkeys(("enum", "type_alias", "module", "namespace"), 2)
    | dict.fromkeys(("variable", "field", "property"), 0)
)
CODE_BLOCK_PRIORITY = (
    dict.fromkeys(NODE_KINDS, 1) | dict.fromkeys(_CALLABLE, 4) | dict.fromkeys(_SHAPES, 3) | dict.fromkeys(("enum", "type_alias"), 2) | dict.fromkeys(("variable", "field", "property"), 0)
)
RESOLUTION_SCORE = (
    dict.fromkeys(NODE_KINDS, 2) | dict.fromkeys(_CALLABLE, 9) | dict.fromkeys((*_SHAPES, "protocol"), 8) | {"component": 7} | dict.fromkeys(_VALUES, 5)
    | dict.fromkeys(("module", "namespace", "enum", "type_alias"), 4) | dict.fromkeys(("import", "export", "parameter"), 1)
)
WORKSPACE_RANK = (
    dict.fromkeys(NODE_KINDS, 5) | dict.fromkeys(_CALLABLE, 0) | dict.fromkeys((*_SHAPES, "protocol", "component"), 1) | dict.fromkeys(("enum", "type_alias"), 2)
    | dict.fromkeys(("module", "namespace"), 3) | dict.fromkeys((*_VALUES, "enum_member"), 4)
)
TAG_LETTER = {
    "class": "c", "struct": "s", "interface": "i", "trait": "t", "protocol": "i", "function": "f", "method": "m", "property": "p", "field": "F", "variable": "v",
    "constant": "C", "enum": "e", "enum_member": "E", "type_alias": "T", "namespace": "n", "parameter": "a", "component": "x",
}
TAG_LANGUAGE = {
    "c": "C", "cpp": "C++", "javascript": "JavaScript", "typescript": "TypeScript", "tsx": "TypeScript", "jsx": "JavaScript", "python": "Python", "go": "Go",
    "rust": "Rust", "shell": "Sh", "esqlc": "C",
}
#: numbers editors use for kinds of symbols
EDITOR_KIND = {
    "file": 1, "module": 2, "namespace": 2, "import": 3, "export": 3, "class": 5, "struct": 5, "component": 5, "method": 6, "property": 7, "field": 8, "enum": 10, "interface": 11, "trait": 11,
    "protocol": 11, "function": 12, "variable": 13, "parameter": 13, "constant": 14, "enum_member": 22, "type_alias": 26,
}
LOW_VALUE = ("import", "export", "parameter")
UNTAGGED = ("import", "export", "file", "module")
DEFINITIONS = ("class", "struct", "interface", "trait", "protocol", "function", "method", "enum", "type_alias", "component")
CONTAINERS = ("class", "struct", "interface", "trait", "protocol", "enum", "module", "namespace", "component")


def lookup(values: dict[str, object], column: Column, default: object) -> Column:
    """Value of a small fixed table at a column."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default))


def case_sql(values: dict[str, object], column: str, default: object) -> str:
    """The same lookup as SQL text."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    groups: dict[object, list[str]] = {}
    for k, v in values.items():
        groups.setdefault(v, []).append(f"'{k}'")
    arms = " ".join(f"WHEN {column} IN ({', '.join(ks)}) THEN {show(v)}" for v, ks in groups.items())
    return f"CASE {arms} ELSE {show(default)} END"


def kind_dim(spark: SparkSession) -> DataFrame:
    """One row per node kind with every attribute."""
    rows = [
        (k, WEIGHT.get(k, 0), IMPLEMENTATION_BIAS.get(k, 0), ENTRY_PRIORITY[k], RESOLUTION_SCORE[k], WORKSPACE_RANK[k], TAG_LETTER.get(k, "u"))
        for k in NODE_KINDS
    ]
    return spark.createDataFrame(
        rows, "kind string, kind_weight int, impl_bias int, entry_priority int, resolution_score int, workspace_rank int, tag_letter string"
    )


def known_node_kind(column: Column) -> Column:
    """Unknown node kinds read as variable, unknown edge kinds as references, unknown languages as python."""
    return F.when(column.isin(*NODE_KINDS), column).otherwise("variable")


def known_edge_kind(column: Column) -> Column:
    return F.when(column.isin(*EDGE_KINDS), column).otherwise("references")


def known_language(column: Column) -> Column:
    return F.when(column.isin(*LANGUAGES), column).otherwise("python")
