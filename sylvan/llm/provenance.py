"""Generated, minified or vendored source files, and data saved as code.

Per language a character trigram model of identifiers is trained over all files (each file weighing
the same), and every file is scored with it: names far from the language's usual cross-entropy in a
dense layout are mangled, names that differ only in digits come from a template. Style of naming is
compared with the rest of the repository. Path and head comments decide where a body written by a tool
or by another project cannot be told from one written by hand.

The texts are read once: that pass gives every file's features and trigrams, and at the end of each split
what its files add to the models; scores follow from the staged trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import one_content, repository, tasks
from sylvan.staging import Staging
from sylvan.tables import read

#: standard deviations above the language's mean cross-entropy from which the names of a dense text are mangled
MANGLED_SD = 1.0
#: share of names that stay apart once digits are folded, under which the names of a dense text come from a template
TEMPLATE_DIVERSITY = 0.85
NUMBERED_DIVERSITY, NUMBERED_NAMES = 0.5, 20  # outside dense layout: most names are numbered copies of others
#: names written in another style than nearly all others of the repository and language, from so many names and files on
FOREIGN_STYLE, FOREIGN_NAMES, FOREIGN_FILES = 0.9, 8, 10
DENSE_LINE, MEAN_DENSE_LINE, DENSE_BLANKS = 250, 150, 0.15
WRAPPED_LINE, WRAPPED_BLANKS = 80, 0.1  # mean line and blanks of dense text that was broken into lines
DATA_SHARE, DATA_CHARS = 0.5, 2_000
ALL_DATA_SHARE, ALL_DATA_CHARS = 0.9, 500  # a file with hardly anything but literals may be shorter
LANGUAGES = 12  # the parsers' languages and one for all others: bounds the models

_FEATURES = (
    "path string, language string, path_evidence string, head_evidence string, diversity double, literal_share double, literal_chars bigint, "
    "longest int, per_line double, blank_share double, odd_share double, wordy int, n_names int, snake double, camel double, styled int"
)
#: rows of files carry features, trigrams and their counts; rows of models (null path) the weights a split adds
_READ = _FEATURES + ", grams array<int>, times array<int>, weights array<bigint>"


def _language(name: str | None) -> str:
    from sylvan.llm.syntax import LANGUAGES as known
    from sylvan.llm.syntax import canonical_language

    found = canonical_language(name)
    return found if found in known else "other"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The one pass over the texts: a row per file, and at the end of the split what its files add to the model
    of each language."""
    from sylvan.llm.provenance_features import ALPHABET, features, gram_counts, head_comments, head_evidence, naming_style, path_evidence, template_diversity, weights

    columns = [c.split()[0] for c in _READ.split(", ")]
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        rows = []
        for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
            language, content = _language(language), content or ""
            f = features(content, language)
            style = naming_style(f["names"])
            grams, times = gram_counts(f["names"])
            if len(grams):
                sums.setdefault(language, np.zeros(ALPHABET**3, np.int64))[grams] += weights(times)
            rows.append(
                (path, language, path_evidence(path), head_evidence(head_comments(content, language)), template_diversity(f["names"]), f["literal_share"], f["literal_chars"],
                 f["longest"], f["per_line"], f["blank_share"], f["odd_share"], f["wordy"], len(f["names"]), style.get("snake", 0.0), style.get("camel", 0.0), int(style.get("n", 0)), grams, times, None)
            )
        yield pd.DataFrame(rows, columns=columns)
    models = []
    for language, total in sums.items():
        used = np.flatnonzero(total)
        models.append((None, language, *[None] * 14, used.astype(np.int32), None, total[used]))
    out = pd.DataFrame(models, columns=columns)
    whole = ["literal_chars", "longest", "wordy", "n_names", "styled"]
    yield out.astype({c: "Int64" for c in whole})


def _scorer(shared):
    def entropy(grams: pd.Series, times: pd.Series, language: pd.Series) -> pd.Series:
        from sylvan.llm.provenance_features import cross_entropy

        models = shared.value
        return pd.Series([cross_entropy(g, t, models[name]) if len(g) else None for g, t, name in zip(grams, times, language)], dtype="float64")

    return F.pandas_udf(entropy, "double")


def _models(read_rows: DataFrame) -> dict[str, np.ndarray]:
    """Bits per trigram of each language: at most ``LANGUAGES`` arrays of ``ALPHABET`` cubed numbers, whatever the corpus."""
    from sylvan.llm.provenance_features import ALPHABET, bits

    added = read_rows.filter(F.col("path").isNull()).select("language", F.explode(F.arrays_zip("grams", "weights")).alias("g"))
    totals: dict[str, np.ndarray] = {}
    for r in added.groupBy("language", F.col("g.grams").alias("gram")).agg(F.sum("g.weights").alias("weight")).toLocalIterator():
        totals.setdefault(r["language"], np.zeros(ALPHABET**3, np.int64))[r["gram"]] = r["weight"]
    return {language: bits(total) for language, total in totals.items()}


def file_provenance(files: DataFrame, contents: DataFrame) -> DataFrame:
    """path, repository, language, verdict (generated, minified, vendored, data or null), evidence, and the scores.

    One row per distinct path of ``files``; files without content are judged by their path, empty ones too.
    Null paths are left out, a null or unknown language is taken as 'other', repeats count once, empty
    tables give no rows, other columns are ignored.
    """
    spark = files.sparkSession
    n = tasks(spark)
    st = Staging(spark, "provenance")
    record = (
        files.filter(F.col("path").isNotNull())
        .select("path", "language", "indexed_at")
        .repartition(n, "path")
        .groupBy("path")
        .agg(F.max(F.struct("indexed_at", "language")).alias("r"))
        .select("path", "r.language")
    )
    joined = record.join(one_content(contents, n), "path", "left")
    rows = st.put(joined.select("path", "language", "content").mapInPandas(_read, _READ), "read")
    score = _scorer(spark.sparkContext.broadcast(_models(rows)))
    scored = rows.filter(F.col("path").isNotNull()).withColumn("entropy", score("grams", "times", "language")).drop("grams", "times", "weights")
    scored = st.put(scored, "scores")
    usual = scored.filter("n_names >= 5").groupBy("language").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("sd"))
    scored = scored.withColumn("repository", repository(F.col("path")))
    style = scored.groupBy("repository", "language").agg(F.avg("snake").alias("repo_snake"), F.avg("camel").alias("repo_camel"), F.count("*").alias("repo_files"))
    scored = scored.join(F.broadcast(usual), "language", "left").join(style, ["repository", "language"])  # usual: one row per language
    far = (F.col("entropy") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    scored = scored.withColumn("names_sd", far).withColumn(
        "style_distance", (F.abs(F.col("snake") - F.col("repo_snake")) + F.abs(F.col("camel") - F.col("repo_camel"))) / 2
    )
    dense = (F.col("longest") >= DENSE_LINE) & (F.col("per_line") >= MEAN_DENSE_LINE) & (F.col("blank_share") < DENSE_BLANKS)
    dense = dense | (F.col("per_line") >= WRAPPED_LINE) & (F.col("blank_share") < WRAPPED_BLANKS)
    code = (F.col("odd_share") < 0.005) & (F.col("wordy") >= 3)
    mangled = dense & code & ((F.col("names_sd") >= MANGLED_SD) | (F.col("diversity") < TEMPLATE_DIVERSITY))
    mainly_data = (F.col("literal_share") >= DATA_SHARE) & (F.col("literal_chars") >= DATA_CHARS)
    mainly_data = mainly_data | (F.col("literal_share") >= ALL_DATA_SHARE) & (F.col("literal_chars") >= ALL_DATA_CHARS)
    numbered = ~dense & (F.col("diversity") < NUMBERED_DIVERSITY) & (F.col("n_names") >= NUMBERED_NAMES)
    foreign = ~dense & (F.col("style_distance") >= FOREIGN_STYLE) & (F.col("styled") >= FOREIGN_NAMES) & (F.col("repo_files") >= FOREIGN_FILES)
    verdict = (
        F.when(F.col("head_evidence") == "copy notice", "vendored")
        .when(F.col("head_evidence") == "tool notice", "generated")
        .when(F.col("path_evidence") == "vendor path", "vendored")
        .when(F.col("path_evidence") != "", "generated")
        .when(mangled, "minified")
        .when(mainly_data, "data")
        .when(numbered, "generated")
        .when(foreign, "vendored")
    )
    evidence = (
        F.when(F.col("head_evidence") != "", F.col("head_evidence"))
        .when(F.col("path_evidence") != "", F.col("path_evidence"))
        .when(mangled, "mangled names")
        .when(mainly_data, "mostly literals")
        .when(numbered, "template names")
        .when(foreign, "foreign style")
    )
    return scored.select(
        "path", "repository", "language", verdict.alias("verdict"), evidence.alias("evidence"), "entropy", "names_sd", "diversity", "literal_share", "literal_chars",
        "longest", "per_line", "blank_share", "odd_share", "wordy", "n_names", "style_distance",
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return file_provenance(read(spark, d, "files"), read(spark, d, "file_contents")).filter(F.col("verdict").isNotNull()).select("path")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return file_provenance(read(spark, d, "files"), read(spark, d, "file_contents"))


QUERIES = {"p3_found": p3_found, "p3_files": p3_files}
SQL: dict[str, str] = {}
