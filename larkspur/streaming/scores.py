"""Scores of a stream of companies, each written once: what is scored already isn't asked for, and a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import commits


def score_stream(companies: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, writer: str = "scores", **trigger: object) -> StreamingQuery:
    """A query that adds the scores of a stream of companies to the table scores stored at root.

    Of each batch the companies (by keys) that the table has at that time are left out, those that repeat are scored once, and score gives rows of the table's columns. The rows and the
    batch's number are one commit. If the driver is lost after it, the batch comes again under its number and is found to be in; if before, nothing of it
    is there. A stream begun anew with another checkpoint needs another writer's name, and finds its companies scored.
    """
    spark = companies.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        base = commits.state(spark, root)
        if base.marks.get(writer, -1) >= number:
            return
        known = commits.read(spark, root, "scores", at=base)["scores"]
        new = batch.dropDuplicates(keys).join(known.select(keys).distinct(), keys, "left_anti")
        commits.commit(spark, root, {}, base, used=["scores"], additions={"scores": score(new).select(known.columns)}, mark=(writer, number))

    return companies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
