"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, local mode (tests), where one machine is all there is, sets a temporary
    folder; on a cluster no folder is known to be shared, and that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/termforge-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders that this process has made, oldest first.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there is deleted with the process's other scratch tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: With this setting Spark deletes a command's shuffle files when it ends, not when the driver's memory is cleaned up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_path(df: DataFrame, name: str) -> str:
    """Write to the shared folder; the table's path. The shuffle files of the write are deleted with its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a path in the shared folder, for tasks that read and write files there."""
    if re.match(r"\w+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, name))


def mark() -> int:
    """A point in the list of scratch tables, for ``discard``."""
    return len(_made)


def discard(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Delete the scratch tables made between two marks; only when nothing will read them any more."""
    jvm = spark.sparkContext._jvm
    for i in range(since, len(_made) if until is None else until):
        path = jvm.org.apache.hadoop.fs.Path(_made[i])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frequent_from(rows: DataFrame, most: int) -> int:
    """The least ``total`` of rows that are broadcast: at most ``most`` rows have it. 1 if these are all."""
    halves = rows.groupBy(F.floor(F.log2("total")).cast("int").alias("h")).agg(F.count("*").alias("n"))
    held = 0
    for h, n in sorted(((r.h, r.n) for r in halves.collect()), reverse=True):  # at most 63 rows
        held += n
        if held > most:
            return 1 << (h + 1)
    return 1


@atexit.register
def _sweep() -> None:
    """When the process ends, delete the scratch tables that it made, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        with contextlib.suppress(Exception):
            discard(spark, 0)
