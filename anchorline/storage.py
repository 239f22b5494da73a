"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import signal
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own if there is this machine only (tests); on a cluster each executor would see another one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="anchorline-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        return base
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_written: list[list[str]] = []
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs within are deleted when it ends, not when the driver happens to collect its garbage: for queries whose result is a table by then."""
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before) if before is not None else spark.conf.unset(_DROP)



def materialize(df: DataFrame, tag: str, order: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to a table in the shared folder, in ranges of ``order`` if given, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/anchorline/{tag}-{uuid.uuid4().hex}"
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # named before it is written, so that what an ended job leaves is deleted too
    if _written:
        _written[-1].append(path)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table up to which it is broadcast.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its count (or the count given) allows it, else as it is: a join then shuffles both sides."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL_ROWS else df


def _status(spark: SparkSession, path: str):
    """The file system of a path and the path on it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _status(spark, path)
    return files.exists(where)


def identity(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of change of each file under a path; nothing is read."""
    files, where = _status(spark, path)
    out, found = [], files.listFiles(where, True)
    while found.hasNext():
        x = found.next()
        out.append([x.getPath().getName(), x.getLen(), x.getModificationTime()])
    return sorted(out)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written by ``materialize`` within are deleted at the end: for callers that have written their result by then.

    After an error, tasks that are being stopped may write a little longer: the tables are deleted until they stay away.
    """
    _written.append([])
    try:
        yield
    except BaseException:
        paths, quiet = _written.pop(), 0
        for _ in range(80):
            left = [p for p in paths if exists(spark, p)]
            delete(spark, left)
            quiet = 0 if left else quiet + 1
            if quiet > 6:
                break
            time.sleep(0.25)
        raise
    delete(spark, _written.pop())


@contextlib.contextmanager
def cancelled_by_signals(spark: SparkSession) -> Iterator[None]:
    """Within, an interrupt or a request to end stops the jobs that were started here, and no others; the caller gets a KeyboardInterrupt."""
    tag, asked = f"anchorline-{uuid.uuid4().hex}", []

    def stop(number: int, _frame: object) -> None:
        asked.append(number)
        spark.interruptTag(tag)

    before = {n: signal.signal(n, stop) for n in (signal.SIGINT, signal.SIGTERM)} if threading.current_thread() is threading.main_thread() else {}
    spark.addTag(tag)
    try:
        yield
    except Exception as e:
        if asked:
            raise KeyboardInterrupt(f"ended by signal {asked[0]}") from e
        raise
    finally:
        spark.removeTag(tag)
        for n, handler in before.items():
            signal.signal(n, handler)
    if asked:
        raise KeyboardInterrupt(f"ended by signal {asked[0]}")
