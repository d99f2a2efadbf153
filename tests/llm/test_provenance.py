import random

import pytest
from pyspark.sql import functions as F

from sylvan.llm.parse_check import parse_files, rejection_rates
from sylvan.llm.provenance import file_provenance
from sylvan.llm.provenance_features import head_comments, head_evidence, path_evidence

FILES = "path string, language string, size bigint, indexed_at bigint"


@pytest.mark.parametrize("path", ["r/vendor/lib/a.c", "r\\third_party\\lib\\a.c", "r/x/node_modules/y/a.js", "r/external/lib-1.2/a.c", "r/contrib/upstream/lib/a.py"])
def test_vendor_paths(path):
    assert path_evidence(path) == "vendor path"


@pytest.mark.parametrize("path", ["r/generated/a.py", "r/a.generated.ts", "r/x_pb2.py", "r/a.pb.go", "r/b/__generated__/x.ts", "r/lex.yy.c", "r/p.tab.c", "r/a_gen.go"])
def test_generated_paths(path):
    assert path_evidence(path).startswith("generated")


@pytest.mark.parametrize("path", ["r/generators/a.py", "r/src/external_api/a.c", "r/minimap/a.js", "r/vendors_admin/a.py", "r/deps_graph.ts", "r/general_gen2.py", "r/a_general.py", "vendor-x/src/a.c", "r/bundler/a.js"])
def test_paths_that_only_sound_like_it(path):
    assert path_evidence(path) == ""


@pytest.mark.parametrize(
    "line,want",
    [
        ("Code generated by protoc 3.1. DO NOT EDIT.", "tool notice"), ("@generated", "tool notice"), ("AUTO-GENERATED by x", "tool notice"), ("This file was created automatically by x; manual changes will be lost.", "tool notice"),
        ("Automatisch erzeugt mit x - nicht von Hand bearbeiten", "tool notice"), ("Fichier produit par x, ne pas modifier", "tool notice"), ("Produced by x from y.schema, edit the schema instead", "tool notice"),
        ("Upstream copy of libz v1.2.3; send fixes to the libz project, not here", "copy notice"), ("This file is part of libz, release 1.2.", "copy notice"), ("libz 1.2 - https://z.example/ - distributed under its own terms", "copy notice"),
        ("rows come in generated order", ""), ("Do not edit two shards at once.", ""), ("Auto-generated names are rejected by this check.", ""), ("The ids below are generated by the caller.", ""),
        ("Never edit the lease while a generated report is open.", ""), ("vendor codes are listed in the manual", ""), ("Used to minify the style sheets before upload.", ""), ("Talks to the vendor feed; third-party codes are mapped here.", ""),
    ],
)
def test_notices(line, want):
    assert head_evidence(head_comments(f"// x\n// {line}\nint a;\n", "c")) == want
    assert head_evidence(head_comments(f"int a;\n// {line}\n", "c")) == ""
    assert head_evidence(head_comments(f"package p\n\nimport (\n\t\"fmt\"\n)\n\n// {line}\nfunc f() {{}}\n", "go")) == want
    assert head_evidence(head_comments(f'"""{line}"""\nimport os\n', "python")) == want


@pytest.mark.parametrize("path", ["app/src/pods/list.go", "app/src/code_gen.py", "r/shader_codegen.py", "r/src/externals/a.c"])
def test_names_hand_written_files_have_too(path):
    assert path_evidence(path) == ""


def test_a_notice_names_a_tool():
    assert head_evidence(["This code is generated with love by our team"]) == "" and head_evidence(["This code is generated with protoc 3"]) == "tool notice"


def test_trigrams_and_cross_entropy_equal_a_plain_count():
    import math
    from collections import Counter

    import numpy as np

    from sylvan.llm.provenance_features import ALPHABET, bits, cross_entropy, gram_counts

    names = ["loadQueue", "a", "Über_9", "load_queue"]
    plain = Counter()
    for n in names:
        low = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789_" else "?" for c in n.lower())
        text = "^^" + low + "$"
        plain.update(text[i : i + 3] for i in range(len(text) - 2))
    grams, times = gram_counts(names)
    assert sorted(times.tolist()) == sorted(plain.values()) and times.sum() == sum(plain.values())
    total = np.zeros(ALPHABET**3, np.int64)
    total[grams] = times
    rows = Counter()
    for g, c in plain.items():
        rows[g[:2]] += c
    want = -sum(c * math.log2(0.9 * c / rows[g[:2]] + 0.1 / ALPHABET) for g, c in plain.items()) / sum(plain.values())
    assert abs(cross_entropy(grams, times, bits(total)) - want) < 1e-12
    assert cross_entropy(*gram_counts([]), bits(total)) is None


def hand(i):
    return f"import os\n\ndef load_anchor_{'abcdefgh'[i % 8]}(cursor, ledger):\n    total = cursor + {i}\n    for item in ledger:\n        total += item\n    return total\n"


def test_operator(spark):
    rng = random.Random(1)
    files, contents = [], []

    def put(path, text, language="python", at=1):
        files.append((path, language, 1, at))
        if text is not None:
            contents.append((path, text))

    for i in range(30):
        put(f"r/src/m{i}.py", hand(i))
        put(f"r/web/m{i}.js", f"function drawAnchor{'ABCDEFGH'[i % 8]}(cursor) {{\n  const total = cursor + {i};\n  return total;\n}}\n", "js")
    small = ";".join(f"function {rng.choice('abcxyz')}{rng.randrange(9999)}(e){{for(var r=0;r<e;r++)t.{rng.choice('qwz')}{rng.randrange(999)}(r);return e}}" for _ in range(80))
    put("r/web/app.js", "!function(t){" + small + "}({});", "JavaScript")
    put("r/src/table.py", "rows = [\n" + "\n".join("    " + ", ".join(str(rng.randrange(999)) for _ in range(20)) + "," for _ in range(80)) + "\n]\n")
    put("r/src/blob.py", "BLOB = (\n" + "\n".join(f'    "{rng.getrandbits(280):070x}"' for _ in range(12)) + "\n)\n")
    put("r/web/wrapped.js", "!function(t){" + "\n".join(small[i : i + 120] for i in range(0, len(small), 120)) + "}({});", "js")
    put("r/src/short.py", "rows = [1, 2, 3]\n" + hand(1))
    put("r/vendor/lib/a.py", None)
    put("r/src/gone.py", None)
    put("r/src/empty.py", "")
    put("r/src/tool.py", "# Code generated by x. DO NOT EDIT.\n" + hand(2), None)
    put("r/src/m1.py", hand(1), at=0)
    files.append((None, "python", 1, 1))
    f = spark.createDataFrame(files, FILES).withColumn("verdict", F.lit(1)).withColumn("repository", F.lit("q"))
    c = spark.createDataFrame(contents + [(None, "x")], "path string, content string")
    got = {r["path"]: r["verdict"] for r in file_provenance(f, c).collect()}
    assert {p: v for p, v in got.items() if v} == {"r/web/app.js": "minified", "r/src/table.py": "data", "r/src/blob.py": "data", "r/web/wrapped.js": "minified", "r/vendor/lib/a.py": "vendored", "r/src/tool.py": "generated"}
    assert len(got) == len({p for p, *_ in files if p})
    assert file_provenance(spark.createDataFrame([], FILES), spark.createDataFrame([], "path string, content string")).count() == 0


def test_files_that_do_not_parse(spark):
    files = [("r\\a.py", "py", 1, 2), ("r\\a.py", "go", 1, 1), ("r/b.c", "C", 1, 1), ("r/c.go", None, 1, 1), ("r/d.py", "python", 1, 1), ("q/e.rs", "rust", 1, None), (None, "c", 1, 1), ("r/no.c", "c", 1, 1)]
    contents = [("r\\a.py", "x = 1\n"), ("r/b.c", "int f( {\n"), ("r/b.c", "int f( {\n"), ("r/c.go", "((("), ("r/d.py", None), ("q/e.rs", "fn f() {"), ("z/only.c", "((")]
    f = spark.createDataFrame(files, FILES).withColumn("valid", F.lit(1))
    c = spark.createDataFrame(contents, "path string, content string").withColumn("language", F.lit("x"))
    parsed = parse_files(f, c)
    assert {r["path"]: r["valid"] for r in parsed.collect()} == {"r\\a.py": True, "r/b.c": False, "r/c.go": True, "r/d.py": True, "q/e.rs": False}
    rates = {(r["repository"], r["language"]): r["invalid_rate"] for r in rejection_rates(parsed).collect()}
    assert rates["r", "c"] == 1.0 and rates["r", "python"] == 0.0 and rates["q", "rust"] == 1.0
    assert parse_files(spark.createDataFrame([], FILES), spark.createDataFrame([], "path string, content string")).count() == 0


def test_names_of_a_foreign_style(spark):
    """A file in camel case in a repository of snake case is another project's, one that mixes is not."""
    own = "".join(f"def load_item_{w}(row_{w}, next_{w}):\n    return row_{w} + next_{w}\n\n" for w in "abcdefgh")
    other = "".join(f"def loadItem{w}(rowOf{w}, nextOf{w}):\n    return rowOf{w} + nextOf{w}\n\n" for w in "ABCDEFGH")
    texts = {f"r/src/m{i}.py": own.replace("item", f"item{i}") for i in range(200)} | {"r/src/odd.py": other, "r/src/mixed.py": own + other, "r/src/few.py": "def loadItem(x):\n    return x\n"}
    files = spark.createDataFrame([(p, "python", 1, 1) for p in texts], FILES)
    got = {r["path"]: (r["verdict"], r["evidence"]) for r in file_provenance(files, spark.createDataFrame(list(texts.items()), "path string, content string")).collect() if r["verdict"]}
    assert got == {"r/src/odd.py": ("vendored", "foreign style")}
