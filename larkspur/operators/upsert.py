"""Writes to tables of immutable files: each gives the table's new rows, which go to a new version of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import commits


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of their keys. Of new rows that share keys the one with the greatest _order stays, if they have it."""
    if "_order" in new.columns:
        new = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_order").desc()))).where("_k = 1").drop("_k", "_order")
    return table.join(new.select(keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows are added where their keys aren't there; of those that share keys one stays."""
    return table.unionByName(new.join(table.select(keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def upsert_keeping(table: DataFrame, new: DataFrame, keys: list[str], keeping: list[str]) -> DataFrame:
    """upsert, but where a new row has null in a column of keeping the old value stays."""
    old = table.select(*keys, *(F.col(c).alias(f"_{c}") for c in keeping))
    merged = new.join(old, keys, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in keeping}).select(new.columns)
    return upsert(table, merged, keys)


def replace_groups(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the groups that new has rows of are replaced."""
    return table.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(table: DataFrame, root: str, base: commits.State | None = None) -> int:
    """Commits a new version of a table that is alone at root; its number. base: the state that it was made from, if a commit since then is to be a Conflict."""
    spark = table.sparkSession
    if base is not None:
        return commits.commit(spark, root, {"table": table}, base).number
    return commits.update(spark, root, lambda _: {"table": table}).number


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest version."""
    return commits.read(spark, root)["table"]


def drop_old_versions(spark: SparkSession, root: str) -> int:
    """Deletes all versions but the current one, parts of versions too, as erased rows must be gone from the files; how many went."""
    return commits.forget_old(spark, root)


def snapshot(table: DataFrame, path: str) -> DataFrame:
    """A copy to work on that later versions don't change, and whose changes don't reach the table."""
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)
