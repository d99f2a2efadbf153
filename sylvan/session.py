"""Session helpers: a default builder and sizing questions operators ask of the running session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sylvan", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE with skew splitting, UTC, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def parallelism(spark: SparkSession) -> int:
    """Tasks that can usefully run at once: shuffle partitions or cores, whichever is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame, per_core: int = 3) -> DataFrame:
    """Repartition a *scan* only when it has fewer splits than the cluster has cores.

    Large tables already arrive in many splits and pass through untouched, so no shuffle is
    added at scale; a small table in one file would otherwise keep a Python stage on one core.
    """
    spark = scan.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if have >= want else scan.repartition(want * per_core)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that functions run inside
    Python workers find it however the driver itself was started."""
    import os
    import tempfile
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sylvan-"), "sylvan_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
