"""Session set-up, table loading and the shared work folder.

Long plans cut their lineage by writing a table below the folder that the cluster names in
``spark.checkpoint.dir``.  Every executor can read that folder, so a lost executor costs only
its running tasks.  Where the setting is missing (tests on a local master) a temporary folder is
used; on a cluster its absence is an error, as a machine-local folder would lose data there.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_USED: set[str] = set()


def builder(app: str = "quillmine", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """A builder with the settings the plans rely on: UTC, AQE with skew handling, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLMINE_DRIVER_MEMORY", "12g"))
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, limit: int, what: str) -> DataFrame:
    """``df`` itself once its rows are known to be at most ``limit``, so that it may go to every task."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} has more than {limit} rows; it can't be sent to every task, so apply the operator to parts of it")
    return df


def _drop_used() -> None:
    """Remove this process's tables when it ends; nothing can read them after that."""
    for path in _USED:
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
        elif (spark := SparkSession.getActiveSession()) is not None:
            remove_path(spark, path)
    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, so that tasks that read files themselves find the same file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:///", files.makeQualified(path).toString()).rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return qualified(spark, base)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillmine-"))
    return "file://" + _LOCAL[0]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    root = f"{shared_dir(spark)}/quillmine/{spark.sparkContext.applicationId}"
    if not _USED:
        atexit.register(_drop_used)
    _USED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


#: Drops the shuffle files of a query when it has ended; else they stay until the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, parts: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the columns ``parts``, and read it back: lineage ends at durable files.

    Nothing reads the shuffles of this one write again, so they are dropped with its end.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).partitionBy(*parts).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later step reads."""
    for path in {re.sub(r"(/[^/]*=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)
