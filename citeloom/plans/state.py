"""State between steps: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that a query removes its shuffle files once it is over.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _set_dir(spark)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        found = _set_dir(spark)
    return found.rstrip("/")


def _set_dir(spark: SparkSession) -> str | None:
    """The folder that setCheckpointDir was given, which the session's settings don't show."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get() if current.isDefined() else None


def kept_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/citeloom/{name}"
    atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def keep(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write df once and read it back: lineage ends here, and a lost executor costs a re-read.

    The shuffle files behind it go as soon as it is written. compact: for the largest tables. They are packed tighter, and
    the shuffle files of queries that are over are let go.
    """
    path = kept_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with _tidy(df.sparkSession):
        df.write.parquet(path, compression="zstd" if compact else None)
    if compact:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return _kept(df, path)


def keep_parts(make: Callable[[int], DataFrame], parts: int, name: str) -> DataFrame:
    """The rows of make(0) to make(parts - 1), written together and compact. One part has shuffle files at a time."""
    first = make(0)
    path = kept_path(first.sparkSession, f"{name}-{uuid.uuid4().hex}")
    for k in range(parts):
        with _tidy(first.sparkSession):
            (make(k) if k else first).write.parquet(path, mode="append", compression="zstd")
    return _kept(first, path)


def _kept(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files at its end, not when the driver's JVM happens to collect them. Should they
    be asked for again, Spark makes them again."""
    before = spark.conf._jconf.getOption(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before.get()) if before.isDefined() else spark.conf.unset(TIDY)


def discard(df: DataFrame) -> None:
    """Remove what keep() wrote for df, once nothing will read it any more."""
    spark = df.sparkSession
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), df._kept)


def _remove(jvm, hadoop, path: str) -> None:
    """Also works after the session has stopped, as long as its JVM lives."""
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    except Exception:  # the JVM has gone; nothing can be tidied any more
        return
