def test_many_numbered_names_are_generated_in_any_layout(spark):
    from sylvan.llm.provenance import file_provenance

    made = "".join(f"def handler_{i}(value):\n    return convert_{i}(value)\n\n\n" for i in range(40))
    words = "apple brick cloud delta ember flint grove heron ivory joker knoll lemon mango north ocean pearl quilt raven stone tiger umber vapor wheat yield zebra".split()
    written = "".join(f"def {w}(value):\n    return {w}_of(value)\n\n\n" for w in words)
    few = "".join(f"def handler_{i}(value):\n    return value\n\n\n" for i in range(5))
    texts = {"r/a/made.py": made, "r/a/written.py": written, "r/a/few.py": few}
    files = spark.createDataFrame([(p, "python", 1) for p in texts], "path string, language string, indexed_at bigint")
    contents = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = {r["path"]: (r["verdict"], r["evidence"]) for r in file_provenance(files, contents).collect()}
    assert got == {"r/a/made.py": ("generated", "template names"), "r/a/written.py": (None, None), "r/a/few.py": (None, None)}
