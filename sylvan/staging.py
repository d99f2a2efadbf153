"""Tables written between rounds of iterative operators.

Lineage is cut by writing Parquet into the folder the cluster shares (``spark.checkpoint.dir``),
so a lost executor costs nothing but the tasks it was running. Only where that setting is absent
and the master is local (tests) a temporary folder stands in.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="sylvan-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


_OPEN: list[list[Staging]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Whatever is staged inside is removed at the end: for applications that live long. DataFrames made inside
    must have been used or written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for st in _OPEN.pop():
            st.clear()


class Staging:
    """Writes DataFrames to the shared folder and removes those no longer needed.

    Tables still reachable from a returned DataFrame stay until the enclosing ``scope`` or the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/sylvan-{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        if _OPEN:
            _OPEN[-1].append(self)
        else:
            atexit.register(self.clear)

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes a table and reads it back; with ``by`` in a folder for each value of that column."""
        path = f"{self.base}/{self.count:03d}-{name}"
        self.count += 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._sylvan_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def put_counted(self, df: DataFrame, name: str, by: str | None = None, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``put`` with aggregates taken while the rows are written, so that no second job reads them. A task that
        runs again is not counted twice in one write, since only the successful stage attempt reports."""
        seen = Observation()
        written = self.put(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name, by)
        found = seen.get
        return written, {n: int(found.get(n) or 0) for n in counts}

    def drop(self, *tables: DataFrame) -> None:
        """Remove staged tables that no later plan reads."""
        for table in tables:
            path = getattr(table, "_sylvan_path", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the JVM may already be gone at exit
            pass
