"""The ledger and the responses as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import REOPENING

DECISION = "uid long, id long, status string"
STATE = "ids array<long>, statuses array<string>, reverses array<long>"


def _fold(rows: list[tuple[int, str, int | None]]) -> tuple[int, str] | None:
    undone = {r for _, s, r in rows if s == "undone" and r is not None}
    for id_, status, reverses in sorted(rows, reverse=True, key=lambda r: r[0]):
        if id_ not in undone and not (status == "undone" and reverses is not None):
            return None if status in REOPENING else (id_, status)
    return None


def current_decisions(ledger: DataFrame) -> DataFrame:
    """uid, id and status of the decision that stands after each batch, for companies with new rows; null where a company is open.

    ledger: a stream of uid, id, status, reverses. The state of a company is its own rows, in any order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, statuses, reverses = (list(x) for x in state.get) if state.exists else ([], [], [])
        for batch in batches:
            ids += batch["id"].tolist()
            statuses += batch["status"].tolist()
            reverses += [None if pd.isna(r) else int(r) for r in batch["reverses"]]
        state.update((ids, statuses, reverses))
        found = _fold(list(zip(ids, statuses, reverses, strict=True)))
        yield pd.DataFrame({"uid": [key[0]], "id": pd.array([found and found[0]], "Int64"), "status": [found and found[1]]})

    rows = ledger.select("uid", "id", "status", "reverses")
    return rows.groupBy("uid").applyInPandasWithState(step, DECISION, STATE, "update", GroupStateTimeout.NoTimeout)


def answers_in_time(mails: DataFrame, responses: DataFrame, days: int = 21) -> DataFrame:
    """Responses that came 0 to days whole days after a company's mail. mails: uid, id, sent_at; responses: uid, answered_at; both streams.

    Both sides are kept no longer than the window, as watermarks on either let Spark drop what can't meet any more.
    """
    left = mails.withWatermark("sent_at", "1 day").select(F.col("uid").alias("mail_uid"), "id", "sent_at")
    right = responses.withWatermark("answered_at", "1 day")
    near = F.col("answered_at").between(F.date_trunc("day", F.col("sent_at")), F.col("sent_at") + F.expr(f"interval {days + 1} days"))
    whole = F.datediff(F.to_date("answered_at"), F.to_date("sent_at"))
    return left.join(right, (F.col("mail_uid") == F.col("uid")) & near).where(whole.between(0, days)).select("uid", "id", "sent_at", "answered_at")


def run_to_end(stream: DataFrame, spark: SparkSession, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """All that is there now, run through a stream; the rows it put out."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
