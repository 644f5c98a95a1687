"""Folds over the append-only decision ledger (id, uid, status, decided_at, reverses): what each company's state is now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The statuses that a decision may have, and those after which a company is open again.
STATUSES = ("sent", "skipped", "never", "not_sent", "bounced", "undone")
REOPENING = ("undone", "not_sent", "bounced")


def undone_ids(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'undone' and reverses is not null").select(F.col("reverses").alias("id")).distinct()


def _standing(ledger: DataFrame, *statuses: str) -> DataFrame:
    """What rows of these statuses reverse, unless they were undone themselves."""
    rows = ledger.where(F.col("status").isin(*statuses) & F.col("reverses").isNotNull())
    return rows.join(undone_ids(ledger), "id", "left_anti").select(F.col("reverses").alias("id")).distinct()


def never_left(ledger: DataFrame) -> DataFrame:
    """Mails that turned out not to have been sent."""
    return _standing(ledger, "not_sent")


def taken_back(ledger: DataFrame) -> DataFrame:
    """Mails that weren't sent, or came back."""
    return _standing(ledger, "not_sent", "bounced")


def latest(rows: DataFrame, *, by: str = "uid", order: str = "id") -> DataFrame:
    """The newest row for each key: the window ends at the first rank, so tasks hand on a row a key."""
    first = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def current_decision(ledger: DataFrame) -> DataFrame:
    """uid, id and status of the decision that stands for each company that has one; reopened companies aren't there."""
    live = ledger.join(undone_ids(ledger), "id", "left_anti").where("not (status = 'undone' and reverses is not null)")
    return latest(live).where(~F.col("status").isin(*REOPENING)).select("uid", "id", "status")


def was_contacted(ledger: DataFrame) -> DataFrame:
    """Companies with a mail that wasn't taken back."""
    return ledger.where("status = 'sent'").join(taken_back(ledger), "id", "left_anti").select("uid").distinct()


def reported_mails(ledger: DataFrame) -> DataFrame:
    """Each company's latest mail that left, come back or not."""
    return latest(ledger.where("status = 'sent'").join(never_left(ledger), "id", "left_anti"))


def logged_mails(ledger: DataFrame) -> DataFrame:
    """Each company's latest mail that neither failed to leave nor came back."""
    return latest(ledger.where("status = 'sent'").join(taken_back(ledger), "id", "left_anti"))


def decided(ledger: DataFrame) -> DataFrame:
    """Companies whose newest row isn't an undoing. Simpler than current_decision, and kept apart from it on purpose."""
    return latest(ledger).where("status <> 'undone'").select("uid")


def newest(ledger: DataFrame) -> DataFrame:
    """The newest row of the whole ledger: the only one that may be undone."""
    return ledger.orderBy(F.col("id").desc()).limit(1)


def closed_because(companies: DataFrame, ledger: DataFrame, suppression: DataFrame) -> DataFrame:
    """uid and reason: suppressed, else the decision that stands, else null."""
    flags = suppression.select("uid").distinct().withColumn("suppressed", F.lit(True))
    rows = companies.select("uid").join(flags, "uid", "left").join(current_decision(ledger).select("uid", "status"), "uid", "left")
    return rows.select("uid", F.when(F.col("suppressed"), "suppressed").otherwise(F.col("status")).alias("reason"))


def off_limits_because(companies: DataFrame, ledger: DataFrame, suppression: DataFrame) -> DataFrame:
    """uid and reason: suppressed, else never (whenever it was said), else contacted, else null."""
    flag = lambda df, name: df.select("uid").distinct().withColumn(name, F.lit(True))
    rows = companies.select("uid").join(flag(suppression, "suppressed"), "uid", "left").join(flag(ledger.where("status = 'never'"), "never"), "uid", "left").join(flag(was_contacted(ledger), "contacted"), "uid", "left")
    return rows.select("uid", F.coalesce(*(F.when(F.col(c), c) for c in ("suppressed", "never", "contacted"))).alias("reason"))


def numbered(rows: DataFrame, keys: dict[str, Column], order: list, name: str) -> DataFrame:
    """rows with their number, from 1, in the order of keys (never null) and then of order.

    Rows are numbered within their keys, and keys begin where those before them end, so no task gets all rows: only the counts meet in one.
    """
    rows = rows.withColumns({f"_key_{k}": c for k, c in keys.items()})
    names = [f"_key_{k}" for k in keys]
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_begins", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return rows.withColumn("_at", within).join(F.broadcast(begins), names).withColumn(name, F.col("_begins") + F.col("_at")).drop("_begins", "_at", *names)


def append(ledger: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with the decisions of a known status, numbered on from its largest id by time and company, and the decisions that were refused.

    Guards on what a card allows are review.answered, whose rows come here.
    """
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = numbered(decisions.where(known), {"day": F.coalesce(F.to_date("decided_at"), F.lit("0001-01-01").cast("date"))}, ["decided_at", "uid"], "_n")
    new = new.join(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_n")).drop("_last", "_n")
    return ledger.unionByName(new, allowMissingColumns=True), decisions.where(~known)
