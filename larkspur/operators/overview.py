"""What the pages of a reviewer show: the log in order, a run's cards with all that stands on them, and where the runs are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contacts import answer, cards, runs_overview, waiting
from .ledger import current_decision, latest, logged_mails, numbered

Tables = Mapping[str, DataFrame]
NO_SITE = "no website found"


def log_in_order(t: Tables) -> DataFrame:
    """n, kind, tag, company, person, at and answer of all links and mails, the newest first, those without a time last: a link's is when its answer began, a mail's when it was sent."""
    companies, answers = t["companies"].select("uid", "name"), t["responses"]
    uid = F.col("uid").cast("string")
    links = t["invites"].join(answers, "uid", "left").join(companies, "uid", "left").select(F.lit("link").alias("kind"), F.col("code").alias("tag"), F.coalesce("name", uid).alias("company"), "person", F.col("started_at").alias("at"), answer().alias("answer"))
    person = latest(t["contacts"]).select("uid", "person")
    mails = logged_mails(t["ledger"]).select("uid", "decided_at").join(person, "uid", "left").join(companies, "uid", "left").join(answers, "uid", "left")
    mails = mails.select(F.lit("mail").alias("kind"), uid.alias("tag"), F.coalesce("name", uid).alias("company"), "person", F.col("decided_at").alias("at"), answer().alias("answer"))
    day = F.coalesce(-F.unix_date(F.to_date("at")), F.lit(2_147_483_647))
    return numbered(links.unionByName(mails), {"day": day}, [F.col("at").desc(), "kind", "tag"], "n")


def wide_cards(t: Tables, run_id: str, states: DataFrame) -> DataFrame:
    """A run's cards in the order of work with company, reason, contact, draft, decision and what blocks sending. states: of review.card_states."""
    ranked = cards(t, run_id)
    of_run = t["results"].where(F.col("run_id") == run_id)
    reason = F.coalesce(F.col("reason"), F.concat("error_kind", F.lit(" error")))
    rows = ranked.join(of_run.select("uid", reason.alias("reason")), "uid", "left").join(t["companies"].select("uid", "name", "municipality"), "uid", "left")
    sites = t["sites"].groupBy("uid").agg(F.min("url").alias("site"))
    state = states.select("uid", "decision", "draft_id", F.array_join("problems", "; ").alias("problems"), "email", "person", "kind", "suppressed", "blocked")
    return rows.join(sites, "uid", "left").join(state, "uid", "left").select("rank", "uid", "name", "municipality", "recommendation", "batch_no", "reason", "site", "person", "email", "kind", "draft_id", "problems", "decision", "suppressed", "blocked")


def home(t: Tables) -> DataFrame:
    """run_id, n, send, failed, finished_at, waiting and whether it is the first (of those finished last) in which something waits, of each run."""
    rows = runs_overview(t["results"]).join(waiting(t).withColumnRenamed("n", "waiting"), "run_id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    first = rows.where("waiting > 0").agg(F.max(F.struct("finished_at", "run_id")).alias("x")).select(F.col("x.run_id").alias("_first"))
    return rows.join(F.broadcast(first)).withColumn("first_waiting", F.coalesce(F.col("run_id") == F.col("_first"), F.lit(False))).drop("_first")


def without_site(results: DataFrame, run_id: str) -> DataFrame:
    """uid and reason of a run's companies for which no website was found, which may be tried again."""
    return results.where((F.col("run_id") == run_id) & F.col("error_kind").isNull() & F.col("reason").startswith(NO_SITE)).select("uid", "reason")


def open_cards(t: Tables) -> DataFrame:
    """run_id and uid of the companies to send to without a decision that stands."""
    return t["results"].where("recommendation = 'send'").join(current_decision(t["ledger"]).select("uid"), "uid", "left_anti").select("run_id", "uid")


def asked_again(asked: DataFrame, score, check, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Scores of asked, and the companies that have none after so many rounds: what an answer left out, or gave in no usable form, is asked for again.

    score: asked to answers; check: answers and asked to those that count and those missing (candidates.validated_scores).
    """
    good, missing = check(score(asked), asked)
    for _ in range(rounds - 1):
        more, missing = check(score(missing), missing)
        good = good.unionByName(more)
    return good, missing

