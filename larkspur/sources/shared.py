"""The folder that the driver and all executors share, and what is done to its files from the driver."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a temporary one if all runs in this process, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared_folder.own = base = getattr(shared_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    return f"{base}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out over all tasks, for work that costs much more than moving them: a file of few row groups would leave it to few tasks, however large it is."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join in which both sides are dealt out. Sizes are judged by those of files, and a stored table of like values takes a small part of what its rows take once a task or the driver holds them."""
    return left.join(right.hint("merge"), on, how)


def _of(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    at, fs = _of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def there(spark: SparkSession, path: str) -> bool:
    at, fs = _of(spark, path)
    return fs.exists(at)


def text_of(spark: SparkSession, path: str) -> str:
    at, fs = _of(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _of(spark, path)
    fs.delete(at, True)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that appears whole, and only if there was none of this name: of any number of writers one gets True.

    The text goes to a file of another name first. On a local disk that is then linked, elsewhere renamed; either fails if the name is taken. The
    latter holds for HDFS; a store whose rename replaces files needs a lock of its own.
    """
    at, fs = _of(spark, path)
    draft, _ = _of(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(draft, at)
        local = lambda p: p.toUri().getPath()
        try:
            os.link(local(draft), local(at))
        except FileExistsError:
            return False
        return True
    finally:
        fs.delete(draft, False)
