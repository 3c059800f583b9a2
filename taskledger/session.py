"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_MAX_GROUP_ROWS = 1_000_000
_local_folders: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "taskledger", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, pass the session spark-submit made."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.applicationId in _local_folders:
        return _local_folders[spark.sparkContext.applicationId]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="taskledger-")
    _local_folders[spark.sparkContext.applicationId] = folder
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs run inside leave no shuffle files: Spark removes them at the end of each. Otherwise they stay until the driver
    happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def packed(spark: SparkSession) -> AbstractContextManager[None]:
    """Tables written inside take less disk, and a little more time."""
    return _setting(spark, "spark.sql.parquet.compression.codec", "zstd")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` once and read it back.

    Lineage ends at a stored table, so a lost executor costs one task and not the whole history, and
    later plans see the table's measured size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables as `written` returned them, which nothing reads any more."""
    for table in tables:
        for path in table._jdf.queryExecution().analyzed().relation().location().rootPaths().mkString("\n").split("\n"):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def remove_intermediates(spark: SparkSession) -> bool:
    """Delete what this application wrote with `written`; call it when its results have been stored."""
    return _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold (spark.taskledger.maxGroupRows)."""
    return int(spark.conf.get("spark.taskledger.maxGroupRows", str(DEFAULT_MAX_GROUP_ROWS)))


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application; nothing to do if it came as an archive."""
    app, package = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _shipped or not package.is_dir():
        return
    base = f"{tempfile.mkdtemp(prefix='taskledger-py-')}/{package.name}"
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
    _shipped.add(app)
