"""Who was written to, how runs are getting on, and what waits for a decision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import current_decision, latest, logged_mails, numbered

Tables = Mapping[str, DataFrame]
#: Cards that a task looks over together for the next one.
STRETCH = 1000


def answer() -> Column:
    return F.when(F.col("completed_at").isNotNull(), "completed").when(F.col("started_at").isNotNull(), "started").otherwise("not yet")


def contact_log(t: Tables) -> DataFrame:
    """Personal links and mails in one log: kind, tag, company, person, removable, answer."""
    answers = t["responses"]
    links = t["invites"].join(answers, "uid", "left").join(t["companies"].select("uid", "name"), "uid", "left")
    links = links.select(F.lit("link").alias("kind"), F.col("code").alias("tag"), F.coalesce("name", F.col("uid").cast("string")).alias("company"), "person", (answer() == "not yet").alias("removable"), answer().alias("answer"))
    person = latest(t["contacts"]).select("uid", "person")
    mails = logged_mails(t["ledger"]).select("uid").join(person, "uid", "left").join(t["companies"].select("uid", "name"), "uid", "left").join(answers, "uid", "left")
    uid = F.col("uid").cast("string")
    return links.unionByName(mails.select(F.lit("mail").alias("kind"), uid.alias("tag"), F.coalesce("name", uid).alias("company"), "person", F.lit(False).alias("removable"), answer().alias("answer")))


def run_progress(t: Tables, run_id: str) -> DataFrame:
    """uid, batch_no, name and state of each company that a run drew or finished; the run is part of the joins, so no row is lost."""
    drawn, ended = t["seen"].where(F.col("run_id") == run_id), t["results"].where(F.col("run_id") == run_id)
    rows = drawn.select("uid").union(ended.select("uid")).distinct().join(t["companies"].select("uid", "name"), "uid").join(drawn.select("uid", "batch_no"), "uid", "left")
    rows = rows.join(ended.select("uid", "recommendation", "error_kind", F.lit(True).alias("there")), "uid", "left")
    state = F.when(F.col("there").isNull(), "waiting").when(F.col("error_kind") == "interrupted", "running").when(F.col("error_kind").isNotNull(), "failed").otherwise(F.col("recommendation"))
    return rows.select("uid", "batch_no", "name", state.alias("state"))


def in_order_of_work(progress: DataFrame) -> DataFrame:
    """Rows of run_progress with place: the newest batch first, in it what is running, waiting, failed, done, and then by name."""
    state = F.when(F.col("state") == "running", 0).when(F.col("state") == "waiting", 1).when(F.col("state") == "failed", 2).otherwise(3)
    return numbered(progress, {"batch": -F.coalesce("batch_no", F.lit(-1)), "state": state}, ["name"], "place")


def runs_overview(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("recommendation") == "send", F.lit(False))).alias("send"), F.count_if(F.col("error_kind").isNotNull()).alias("failed"), F.max("finished_at").alias("finished_at"))


def waiting(t: Tables) -> DataFrame:
    """For each run, how many companies to send to have no decision that stands."""
    open_ = t["results"].where("recommendation = 'send'").join(current_decision(t["ledger"]).select("uid"), "uid", "left_anti")
    return open_.groupBy("run_id").agg(F.count("*").alias("n"))


def cards(t: Tables, run_id: str) -> DataFrame:
    """A run's cards in the order of work: rank, uid, recommendation (error for none), batch_no and whether a decision stands."""
    rows = t["results"].where(F.col("run_id") == run_id).join(t["seen"].select("uid", "batch_no"), "uid", "left").join(current_decision(t["ledger"]).select("uid", F.lit(True).alias("closed")), "uid", "left")
    kind = F.when(F.col("error_kind").isNotNull(), "error").otherwise(F.col("recommendation"))
    order = F.when(kind == "send", 0).when(kind == "hold", 1).when(kind == "skip", 2).otherwise(3)
    ranked = numbered(rows, {"order": order, "batch": F.coalesce("batch_no", F.lit(2_147_483_647))}, ["uid"], "rank")
    return ranked.select("rank", "uid", kind.alias("recommendation"), "batch_no", F.coalesce("closed", F.lit(False)).alias("closed"))


def stale_drafts(t: Tables, frame: str) -> DataFrame:
    """uid and why: each company's latest draft, where it has an old frame, was never checked, or failed a check. Null, empty and other problems are three things."""
    why = F.when(F.col("frame_version") != frame, "old frame").when(F.col("problems").isNull(), "unchecked").when(F.col("problems") != "", "failed")
    return latest(t["drafts"]).select("uid", why.alias("why")).where("why is not null")


def errored(results: DataFrame, run_id: str) -> DataFrame:
    """Companies of a run to try again: those with an error."""
    return results.where((F.col("run_id") == run_id) & F.col("error_kind").isNotNull()).select("uid", "error_kind")


def sent_by_month(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'sent'").groupBy(F.date_format("decided_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("sent"))


def address_blocks(contacts: DataFrame, suppression: DataFrame, ledger: DataFrame, key: Column) -> DataFrame:
    """uid, key and reason of contacts that must not be written to: an address of a suppressed company, or of another company that was mailed (the first such)."""
    keyed = contacts.select("uid", key.alias("key")).distinct()
    barred = keyed.join(suppression.select("uid").distinct(), "uid", "left_semi").select("key").distinct().withColumn("suppressed", F.lit(True))
    mailed = keyed.join(ledger.where("status = 'sent'").groupBy("uid").agg(F.min("id").alias("id")), "uid")
    first = mailed.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("id", "uid"))).alias("sent"))
    rows = keyed.join(barred, "key", "left").join(first, "key", "left")
    other = F.when(F.size(F.filter("sent", lambda s: s["uid"] != F.col("uid"))) > 0, F.concat(F.lit("sent for "), F.get(F.filter("sent", lambda s: s["uid"] != F.col("uid")), F.lit(0))["uid"].cast("string")))
    return rows.select("uid", "key", F.coalesce(F.when(F.col("suppressed"), "suppressed"), other).alias("reason")).where("reason is not null")


def next_cards(cards: DataFrame) -> DataFrame:
    """For each card of cards(), the next one without a decision: the nearest after it, else the first of all; null if none waits."""
    rows = cards.withColumn("_bucket", F.floor(F.col("rank") / STRETCH)).withColumn("_open", F.when(~F.col("closed"), F.col("uid")))
    forward = Window.partitionBy("_bucket").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy("_bucket").agg(F.min_by("_open", F.when(F.col("_open").isNotNull(), F.col("rank"))).alias("_first"))
    # windows over a row for each STRETCH cards: few, so that one task can have them
    later = Window.orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_bucket", F.first("_first", True).over(later).alias("_later"), F.first("_first", True).over(every).alias("_any"))
    found = rows.withColumn("_next", F.first("_open", True).over(forward)).join(F.broadcast(firsts), "_bucket")
    return found.select("rank", "uid", F.coalesce("_next", "_later", "_any").alias("next_uid"))


def companies_of_address(t: Tables, key: Column, wanted: str) -> DataFrame:
    """Companies that an address belongs to or that were written to at it. key: of contacts' rows."""
    return t["contacts"].where(key == wanted).select("uid").union(t["ledger"].join(t["contacts"].where(key == wanted).select("uid"), "uid", "left_semi").select("uid")).distinct()


def held_names(t: Tables, uids: DataFrame) -> DataFrame:
    """Names of people that rows of some companies hold: of contacts and of personal links."""
    of = lambda name: t[name].join(uids.select("uid"), "uid", "left_semi").select("person")
    return of("contacts").union(of("invites")).where("person is not null").distinct()


def redraft_candidates(t: Tables, run_id: str, frame: str) -> DataFrame:
    """Companies to write a draft for again: to be sent to, without a decision that stands, not suppressed, and with a stale draft or none."""
    open_ = t["results"].where((F.col("run_id") == run_id) & (F.col("recommendation") == "send")).select("uid")
    open_ = open_.join(current_decision(t["ledger"]).select("uid"), "uid", "left_anti").join(t["suppression"].select("uid"), "uid", "left_anti")
    return open_.join(latest(t["drafts"]).select("uid", F.lit(True).alias("there")), "uid", "left").join(stale_drafts(t, frame), "uid", "left").where("there is null or why is not null").select("uid", F.coalesce("why", F.lit("none")).alias("why"))


def with_addresses(contacts: DataFrame) -> DataFrame:
    """contacts with addresses as an array of email and kind; rows from before there were several have their one address in it."""
    single = F.when(F.col("email").isNotNull(), F.array(F.struct("email", F.col("email_kind").alias("kind")))).otherwise(F.array().cast("array<struct<email:string,kind:string>>"))
    return contacts.withColumn("addresses", F.coalesce("addresses", single) if "addresses" in contacts.columns else single)


def companies_offering(contacts: DataFrame, wanted: str) -> DataFrame:
    """Companies any of whose offered addresses (array of email and kind) is the wanted one."""
    from ..functions.ids import address_key

    return contacts.where(F.exists("addresses", lambda a: address_key(a["email"]) == wanted)).select("uid").distinct()


def draft_staleness(drafts: DataFrame, contacts: DataFrame, frame: str) -> DataFrame:
    """uid and why of each company's latest draft (id, uid, frame_version, problems, contact_id, link, expected_link, fails), the first reason that holds; null if it may be sent.

    contacts: the companies to look at; one without a draft has none. A draft for another contact than the newest, with another link than today's, or that today's rules refuse, is stale.
    """
    newest = latest(contacts).select("uid", F.col("id").alias("_contact"))
    rows = newest.join(latest(drafts), "uid", "left")
    reasons = {
        "none": F.col("id").isNull(), "old frame": F.col("frame_version") != frame, "unchecked": F.col("problems").isNull(), "failed": F.col("problems") != "",
        "other contact": ~F.col("contact_id").eqNullSafe(F.col("_contact")), "other link": ~F.col("link").eqNullSafe(F.col("expected_link")), "fails now": F.col("fails"),
    }
    return rows.select("uid", F.coalesce(*(F.when(c, F.lit(k)) for k, c in reasons.items())).alias("why"))


def run_steps(t: Tables, run_id: str) -> DataFrame:
    """Rows of run_progress with the last step that a company of the run reported; the run is part of that join too."""
    steps = t["progress"].where(F.col("run_id") == run_id).groupBy("uid").agg(F.max("step").alias("step"))
    return run_progress(t, run_id).join(steps, "uid", "left")


def row_of(table: DataFrame, **keys: object) -> DataFrame:
    """The rows of a table with these keys; null is a key like any other."""
    for column, value in keys.items():
        table = table.where(F.col(column).eqNullSafe(F.lit(value)))
    return table


def codes_of_profile(invites: DataFrame, key: Column, wanted: str) -> DataFrame:
    """Codes of links whose profile is the wanted one. key: of invites' rows."""
    return invites.where(key == wanted).select("code").distinct()


def names_of_codes(invites: DataFrame, codes: DataFrame) -> DataFrame:
    return invites.join(codes.select("code"), "code", "left_semi").where("person is not null").select("person").distinct()
