from sylvan.extract.model import node_id
from sylvan.functions.sql import register
from sylvan.functions.terms import split_identifier


def test_functions_under_sql_names(spark):
    assert register(spark) == ["wildcard_match", "split_identifier", "node_id", "builtin_symbol", "extract_symbols"]
    row = spark.sql(
        """SELECT wildcard_match('mergeQueue', 'merge*') a, wildcard_match('mergeQueue', 'MERGE') b, wildcard_match('mergeQueue', '?ergeQueu') c, wildcard_match(NULL, 'x') d,
        split_identifier('loadHTTPQueue_the_x.item') e, node_id('a.py', 'function', 'f', 3) f, builtin_symbol('len', 'python') g, builtin_symbol('gtk_init', 'c') h, builtin_symbol('drain', 'go') i"""
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (True, True, False, None)
    assert row["e"] == split_identifier("loadHTTPQueue_the_x.item") and row["f"] == node_id("a.py", "function", "f", 3)
    assert (row["g"], row["h"], row["i"]) == (True, True, False)


def test_extraction_as_a_table_function(spark):
    register(spark)
    found = spark.sql("SELECT kind, name, start_line FROM extract_symbols('a.py', 'python', 'def f(x):\n    return x\n')")
    assert [tuple(r) for r in found.collect()] == [("function", "f", 1)]
    assert spark.sql("SELECT * FROM extract_symbols(NULL, NULL, NULL)").count() == 0
