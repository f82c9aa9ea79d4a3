"""Spark session settings shared by the library, tests and bench."""

from __future__ import annotations

import pathlib
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces small
# shuffle partitions at run time, skew join splits hot partitions, and
# the broadcast threshold is Spark's own size check for build sides.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    "spark.driver.maxResultSize": "2g",
    "spark.ui.showConsoleProgress": "false",
}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "regilake",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A single-machine session (``local[...]``) without one gets a scratch
    folder. Anywhere else a missing setting is an error: executors could
    not see a folder on the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="regilake-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    The package is zipped once per session and handed to Spark, so that
    Python tasks do not depend on PYTHONPATH of the worker machines.
    """
    sc = spark.sparkContext
    if getattr(sc, "_regilake_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="regilake-ship-")) / "regilake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    sc.addPyFile(str(target))
    sc._regilake_shipped = True


def materialize(df, label: str, free: bool = False):
    """Cut lineage by writing ``df`` once as Parquet under the shared
    checkpoint folder and reading it back (one job, no recomputation; a
    lost executor later re-reads files instead of re-running the plan).
    With ``free`` Spark removes the job's shuffle files as soon as it ends."""
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if free:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if free:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._regilake_path = path
    return table


def discard(*tables) -> None:
    """Delete tables of :func:`materialize` that no later job reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._regilake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
