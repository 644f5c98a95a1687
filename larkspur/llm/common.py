"""What the operators of this package share: the shared folder, staged tables and words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir. Where that is unset, a temporary one if all runs in this process, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared_dir.own = base = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back, which cuts the lineage: a lost executor costs no recomputation. Its shuffle files go once it is written."""
    spark = df.sparkSession
    path, before = staged_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, modulus: int):
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() splits at exactly the six characters that BLANK has."""
    return text.encode("utf-8", "replace").split() if text else []
