"""Snapshots as tags files and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.columns import tag_field
from sylvan.functions.kinds import TAG_LANGUAGE, TAG_LETTER, UNTAGGED, lookup

HEAD = [
    '!_TAG_FILE_FORMAT\t2\t/extended format; --format=1 will not append ;" to lines/',
    "!_TAG_FILE_SORTED\t1\t/0=unsorted, 1=sorted, 2=foldcase/",
    "!_TAG_PROGRAM_NAME\tsylvan\t//",
    "!_TAG_PROGRAM_VERSION\t0.1.0\t//",
]


def tag_lines(nodes: DataFrame) -> DataFrame:
    """One line of a tags file per symbol that can be a tag, with the keys that order them."""
    some = nodes.filter(~F.col("kind").isin(*UNTAGGED))
    signature = F.regexp_replace(F.regexp_replace(F.trim("signature"), r"\{+$", ""), r"\s+$", "")
    qualified = F.coalesce("qualified_name", F.lit(""))
    line = F.concat_ws(
        "\t",
        tag_field(F.col("name")),
        tag_field(F.col("file_path")),
        F.concat(F.greatest("start_line", F.lit(1)).cast("string"), F.lit(';"')),
        lookup(TAG_LETTER, F.col("kind"), "u"),
        F.concat(F.lit("kind:"), "kind"),
        F.concat(F.lit("line:"), F.col("start_line").cast("string")),
        F.concat(F.lit("end:"), F.col("end_line").cast("string")),
        F.concat(F.lit("language:"), lookup(TAG_LANGUAGE, F.col("language"), "Python")),
        F.when(qualified != "", F.concat(F.lit("qualified:"), tag_field(qualified))),
        F.when(F.coalesce(F.length(signature), F.lit(0)) > 0, F.concat(F.lit("signature:"), tag_field(signature))),
    )
    return some.select("name", "file_path", "start_line", line.alias("line"))


def write_tags(nodes: DataFrame, path: str, one_file: bool = False) -> None:
    """A sorted tags file: the head first, then one line a symbol, as a folder of sorted parts that all tasks write.
    With ``one_file`` the parts are then appended to a file of that name, byte by byte, nothing of them held in memory."""
    head = nodes.sparkSession.createDataFrame([(i, h) for i, h in enumerate(HEAD)], "start_line int, line string")
    head = head.select(F.lit(0).alias("part"), F.lit("").alias("name"), F.lit("").alias("file_path"), "start_line", "line")
    rows = head.unionByName(tag_lines(nodes).withColumn("part", F.lit(1)))
    parts = path.rstrip("/") + ".parts" if one_file else path
    rows.orderBy("part", "name", "file_path", "start_line").select("line").write.mode("overwrite").text(parts)
    if one_file:
        join_parts(nodes.sparkSession, parts, path)


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """One file out of the part files of a folder, in their order; the folder goes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, out = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(target)
    fs = source.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    fs.delete(out, True)
    stream = fs.create(out, True)
    try:
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, conf, False)
            part.close()
    finally:
        stream.close()
    fs.delete(source, True)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
