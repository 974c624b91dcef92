"""Session construction and the few session-bound helpers the operators share."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(app: str = "lipika", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A local session for tests, the bench and the command line; on a cluster the caller brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one of a local session where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lipika-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system) for the driver's own file work."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; what is written there goes when the driver's file system closes."""
    path = f"{shared_dir(spark)}/lipika/{label}-{uuid.uuid4().hex}"
    hadoop_path, system = file_system(spark, path)
    system.deleteOnExit(hadoop_path)
    return path


@contextmanager
def shuffle_partitions(spark: SparkSession, rows: int, row_bytes: int, task_bytes: int = 64 << 20) -> Iterator[None]:
    """Within it, shuffles have as many partitions as ``rows`` of ``row_bytes`` need, never fewer than the session's."""
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(own), math.ceil(rows * row_bytes / task_bytes))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
    For queries that run to their end inside, such as ``materialize``. Takes effect from Spark 4.1 on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, keeps column pruning for later readers and
    is removed when the driver's file system closes.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a table that must be small; more than ``most`` are an error, none is dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, whatever their own paths are; once per context."""
    context = spark.sparkContext
    if getattr(context, "_lipika_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory(prefix="lipika-zip-") as folder:  # the driver's own disk: from there it is copied
        target = os.path.join(folder, f"lipika-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for inner, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(inner, name)
                        archive.write(path, os.path.join("lipika", os.path.relpath(path, root)))
        shared = f"{shared_dir(spark)}/lipika/{os.path.basename(target)}"
        hadoop_path, system = file_system(spark, shared)
        system.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{target}"), hadoop_path)
        system.deleteOnExit(hadoop_path)
    context.addPyFile(shared)
    context._lipika_shipped = True
