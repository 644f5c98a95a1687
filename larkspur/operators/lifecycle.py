"""Criteria, runs, drafts and personal links: rows that are replaced, kept, or made anew, by what refers to them."""

from __future__ import annotations

import secrets as randomness

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import CODE_LENGTH
from .ledger import latest
from .upsert import upsert

#: Fixed value: the letters of a personal code: capitals and digits that aren't taken for one another.
CODE_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def criteria_text(must: Column, must_not: Column, positive: Column) -> Column:
    """One block of text for arrays of criteria: what a scorer and a person read."""
    part = lambda name, entries: F.array_join(F.concat(F.array(F.lit(f"{name}:")), F.transform(entries, lambda x: F.concat(F.lit("  - "), x))), "\n")
    return F.concat_ws("\n", part("must", must), part("must_not", must_not), part("positive_signals", positive))


def criteria_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def store_criteria(criteria: DataFrame, history: DataFrame, scores: DataFrame, new: DataFrame, adopt: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """criteria (goal, criteria_hash, text, created_at), history and scores after new sets are stored.

    A set that is replaced goes to history, with when. If asked to, scores without criteria take the hash of a goal's very first set.
    """
    replaced = criteria.join(new.select("goal", F.col("created_at").alias("replaced_at")), "goal")
    first = new.join(criteria.select("goal"), "goal", "left_anti").select("goal", F.col("criteria_hash").alias("_first"))
    if adopt:
        scores = scores.join(F.broadcast(first), "goal", "left").withColumn("criteria", F.coalesce("criteria", "_first")).select(scores.columns)
    return upsert(criteria, new, ["goal"]), history.unionByName(replaced, allowMissingColumns=True), scores


def current_criteria(criteria: DataFrame, goal: str) -> DataFrame:
    return criteria.where(F.col("goal") == goal).select("criteria_hash")


def criteria_of_runs(runs: DataFrame, goal: str) -> DataFrame:
    """Sets that earlier runs for a goal recorded, the oldest first."""
    return runs.where((F.col("goal") == goal) & F.col("criteria").isNotNull()).select("run_id", "criteria", "started_at").orderBy("started_at", "run_id")


def record_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs that begin: status scoring. A run that is begun again starts over."""
    return upsert(runs, new.withColumn("status", F.lit("scoring")).withColumn("finished_at", F.lit(None).cast("timestamp")), ["run_id"])


def finish_run(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """runs with the status (done or failed) and the time of those that ended (run_id, failed, finished_at); a run that isn't there stays so."""
    new = ended.select("run_id", F.when(F.col("failed"), "failed").otherwise("done").alias("_status"), F.col("finished_at").alias("_at"))
    out = runs.join(new, "run_id", "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "finished_at": F.coalesce("_at", "finished_at")}).select(runs.columns)


def rewrite_drafts(drafts: DataFrame, ledger: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """drafts with those of rebuilt (id, new_id, problems, frame_version, created_at) replaced in place, unless a ledger row names them.

    What went out stays as it was: the new text of such a draft is a row of its own, with new_id.
    """
    named = ledger.where("draft_id is not null").select(F.col("draft_id").alias("id")).distinct().withColumn("_named", F.lit(True))
    new = rebuilt.select("id", "new_id", F.struct("problems", "frame_version", "created_at").alias("_new")).join(named, "id", "left")
    rows = drafts.join(new, "id", "left")
    values = lambda: [F.col(f"_new.{c}").alias(c) if c in ("problems", "frame_version") else F.col(c) for c in drafts.columns]
    kept = rows.where("_new is null or _named").select(drafts.columns)
    moved = rows.where("_new is not null and _named is null").select(*values())
    added = rows.where("_new is not null and _named").select(*[F.col("new_id").alias("id") if c == "id" else F.col(f"_new.{c}").alias(c) if c in ("problems", "frame_version", "created_at") else F.col(c) for c in drafts.columns])
    return kept.unionByName(moved).unionByName(added)


def update_latest(table: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row of each company of changes (uid, columns) takes their values; earlier rows stay."""
    newest = latest(table).select("id", "uid").join(changes.select("uid", F.struct(*columns).alias("_new")), "uid").select("id", "_new")
    out = table.join(newest, "id", "left")
    return out.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).select(table.columns)


def record_checks(drafts: DataFrame, checks: DataFrame) -> DataFrame:
    """drafts with the outcome of checks (uid, found: array): empty if they passed. Drafts that weren't checked keep what they have."""
    out = drafts.join(checks.select("uid", F.array_join("found", "; ").alias("_found")), "uid", "left")
    return out.withColumn("problems", F.coalesce("_found", "problems")).select(drafts.columns)


def drafting_outcomes(first: DataFrame, second: DataFrame) -> DataFrame:
    """uid, kept (first, second or null) and reason of sentences that were checked once or twice: first and second have uid and found (the rules broken).

    A sentence that fails is asked for once more; one that fails twice, or whose second never came, is deleted.
    """
    rows = first.select("uid", F.col("found").alias("one")).join(second.select("uid", F.col("found").alias("two")), "uid", "left")
    fine = lambda c: F.coalesce(F.size(c) == 0, F.lit(False))
    kept = F.when(fine("one"), "first").when(fine("two"), "second")
    why = F.when(kept.isNull() & F.col("two").isNull(), "no second draft").when(kept.isNull(), F.concat(F.lit("the draft failed its checks twice: "), F.array_join("two", "; ")))
    return rows.select("uid", kept.alias("kept"), why.alias("reason"))


def new_code(taken: set[str]) -> str:
    """A random personal code that isn't taken."""
    while (code := "".join(randomness.choice(CODE_LETTERS) for _ in range(CODE_LENGTH))) in taken:
        pass
    return code


def record_invite(invites: DataFrame, new: DataFrame) -> DataFrame:
    """invites with new links, unless their code is there."""
    return invites.unionByName(new.join(invites.select("code"), "code", "left_anti"), allowMissingColumns=True)


def remove_invites(invites: DataFrame, responses: DataFrame, codes: DataFrame) -> DataFrame:
    """invites without those of codes that nobody answered."""
    answered = invites.join(responses.where("started_at is not null or completed_at is not null").select("uid").distinct(), "uid", "left_semi").select("code")
    return invites.join(codes.select("code").join(answered, "code", "left_anti"), "code", "left_anti")


def redact_invites(invites: DataFrame, codes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """invites with columns blanked for codes, their rows kept, and how many of those held anything (n)."""
    marked = invites.join(codes.select("code").distinct().withColumn("_gone", F.lit(True)), "code", "left")
    held = F.coalesce(F.col("_gone"), F.lit(False)) & F.greatest(*(F.col(c).isNotNull() for c in columns), F.lit(False))
    blank = marked.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in columns}).select(invites.columns)
    return blank, marked.agg(F.count_if(held).alias("n"))
