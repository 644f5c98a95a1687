"""What a reviewer may do with a card, and the ledger rows that follow from it.

A request names a company, an action and its arguments. Beside the card's state, its guards are an ordered list: the first
that holds answers the request; none, and the action is done.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .contacts import address_blocks
from .decisions import send_block
from .ledger import current_decision, latest

Tables = Mapping[str, DataFrame]
#: What a card may be skipped for, and what a person may be called.
SKIP_REASONS = ("wrong company", "wrong person", "not now")
SALUTATIONS = ("Frau", "Herr", "ohne")
#: Answers to a request: done, asked to confirm, not understood, in conflict with what is so, not there.
DONE, ASK, BAD, CONFLICT, ABSENT = 303, 200, 400, 409, 404


def undoable_bounce(ledger: DataFrame) -> DataFrame:
    """uid, id and address of a bounce that is the newest row of the whole ledger: the only one that may be undone."""
    last = ledger.agg(F.max_by(F.struct("id", "uid", "status", "address"), "id").alias("r")).select("r.*")
    return last.where("status = 'bounced'").select("uid", F.col("id").alias("bounce_id"), F.col("address").alias("bounce_address"))


def drift(written_for: Column, contact: Column, greeting: Column, rebuilt: Column) -> Column:
    """Why a draft no longer matches what it was built from: a newer contact than the one it names, or a greeting other than today's; null if it does. Without a contact nothing is compared."""
    other = (written_for != contact) | (greeting != rebuilt)
    return F.when(contact.isNotNull() & F.coalesce(other, F.lit(False)), F.when(F.coalesce(written_for != contact, F.lit(False)), "a newer contact").otherwise("another greeting"))


def placeholder_link(link: Column) -> Column:
    """Whether a survey's link is an example's: its host is example, or under that ending."""
    host = urls.host(link)
    return F.coalesce((host == "example") | host.endswith(".example"), F.lit(False))


def foreign_link(link: Column, survey_url: str) -> Column:
    """Whether a link doesn't lead to the survey; without a survey each does not."""
    base = survey_url.rstrip("/")
    return ~F.coalesce(link.startswith(base), F.lit(False)) if base else F.lit(True)


def card_states(t: Tables, frame: str, key: Column, survey_url: str, approved: Column) -> DataFrame:
    """A row for each company with what its guards ask about: the decision that stands, the last mail, the draft, the addresses offered and which are barred.

    A draft that passed its checks must also still be what would be written today (`drift`), and its link lead to the survey. approved: whether sending is approved, of the companies' rows.
    """
    decision = current_decision(t["ledger"]).select("uid", F.col("status").alias("decision"), F.col("id").alias("decision_id"))
    mail = t["ledger"].select("id", F.col("address").alias("sent_address"))
    draft = latest(t["drafts"]).select("uid", F.col("id").alias("draft_id"), F.col("frame_version").alias("body"), "problems", (F.col("frame_version") != frame).alias("old_frame"), "contact_id", "greeting", "link")
    contact = latest(t["contacts"]).select("uid", F.col("id").alias("newest_contact"), F.col("email"), "person", F.col("email_kind").alias("kind"))
    offered = t["contacts"].groupBy("uid", "email").agg(F.max_by("email_kind", "id").alias("email_kind")).groupBy("uid").agg(F.map_from_entries(F.collect_set(F.struct("email", "email_kind"))).alias("offered"))
    barred = address_blocks(t["contacts"], t["suppression"], t["ledger"], key).groupBy("uid").agg(F.map_from_entries(F.collect_set(F.struct("key", "reason"))).alias("barred"))
    flag = t["suppression"].select("uid").distinct().withColumn("suppressed", F.lit(True))
    rows = t["companies"].select("uid", approved.alias("approved")).join(decision, "uid", "left").join(mail, F.col("id") == F.col("decision_id"), "left").drop("id")
    for side in (draft, contact, offered, barred, flag, undoable_bounce(t["ledger"])):
        rows = rows.join(side, "uid", "left")
    last = t["ledger"].agg(F.max_by(F.struct("id", "uid", "status"), "id").alias("newest"))
    false = F.lit(False)
    rebuilt = F.concat_ws(" ", F.lit("Guten Tag"), "person")
    rows = rows.join(F.broadcast(last)).withColumn("drift", drift(F.col("contact_id"), F.col("newest_contact"), F.col("greeting"), rebuilt)).withColumns({
        "decided": F.col("decision").isNotNull(), "suppressed": F.coalesce("suppressed", false), "drifted": F.col("drift").isNotNull(), "approved": F.coalesce("approved", false),
        "placeholder_link": placeholder_link(F.col("link")), "foreign_link": foreign_link(F.col("link"), survey_url),
        "problems": F.when(F.col("problems") == "", F.array().cast("array<string>")).otherwise(F.split("problems", "; ")),
    })
    return send_block(rows)


def answered(requests: DataFrame, cards: DataFrame, key: Column) -> DataFrame:
    """requests (id, uid, action, argument, to_address, shown_draft, shown_body, sent_id, confirmed) with code and said, and with status, reverses and address of the ledger row to write, if any.

    key: of to_address or argument, as address_blocks compares them.
    """
    c, no = F.col, F.lit(None)
    known = lambda x: F.coalesce(x, F.lit(False))
    wanted = F.when(c("action") == "send", c("to_address")).otherwise(c("argument"))
    rows = requests.join(cards.withColumn("there", F.lit(True)), "uid", "left").withColumn("_to", wanted).withColumn("_barred", F.try_element_at("barred", key)).withColumn("_kind", F.try_element_at("offered", c("_to")))
    decided = (c("decided"), CONFLICT, F.concat(F.lit("already decided: "), c("decision")))
    offered = [(c("_kind").isNull(), BAD, F.lit("not an address of the card")), (c("_kind") == "third_party", CONFLICT, F.lit("an address on another domain"))]
    unbarred = (c("_barred").isNotNull(), CONFLICT, c("_barred"))
    newest = (c("newest.uid") == c("uid")) & (c("newest.status") == "sent") & (c("newest.id") == c("sent_id"))
    ask = (~known(c("confirmed")), ASK, F.lit("confirm"))
    guards = {
        "send": [
            (c("blocked").isNotNull(), CONFLICT, c("blocked")), (~known((c("shown_draft") == c("draft_id")) & (c("shown_body") == F.sha2("body", 256))), CONFLICT, F.lit("the draft changed")),
            *offered, unbarred, (c("_to") != c("email"), CONFLICT, F.lit("written for another address")),
        ],
        "address": [*offered, unbarred, decided, (c("draft_id").isNull(), CONFLICT, F.lit("no draft to rebuild"))],
        "salutation": [(~c("argument").isin(*SALUTATIONS), BAD, F.lit("no such salutation")), decided, (c("draft_id").isNull() | c("person").isNull(), CONFLICT, F.lit("no draft to a named person"))],
        "skip": [(~c("argument").isin(*SKIP_REASONS), BAD, F.lit("no such reason")), decided],
        "never": [(known(c("decision").isin("never", "sent")), CONFLICT, decided[2]), ask],
        "undo": [(c("bounce_id").isNull() & ~known(c("decision") == "skipped"), CONFLICT, F.concat(F.lit("cannot undo "), F.coalesce("decision", F.lit("nothing"))))],
        "not_sent": [(~known(newest), CONFLICT, F.lit("another decision came after")), ask],
        "bounced": [(~known(c("decision") == "sent"), CONFLICT, F.concat(F.lit("only a sent mail can bounce, this is "), F.coalesce("decision", F.lit("nothing")))), ask],
    }
    answer = lambda code, said: F.struct(F.lit(code).alias("code"), said.alias("said"))
    verdict = F.when(c("there").isNull(), answer(ABSENT, F.lit("no such card")))
    for action, rules in guards.items():
        for holds, code, said in rules:
            verdict = verdict.when((c("action") == action) & known(holds), answer(code, said))
        verdict = verdict.when(c("action") == action, answer(DONE, F.lit("done")))
    rows = rows.withColumn("_v", verdict.otherwise(answer(BAD, F.lit("no such action"))))
    done = c("_v.code") == DONE
    status = F.when(~done, no).when(c("action") == "send", "sent").when(c("action") == "skip", "skipped").when(c("action") == "undo", "undone").when(c("action").isin("never", "not_sent", "bounced"), c("action"))
    reverses = F.when(~done, no).when(c("action") == "undo", c("bounce_id")).when(c("action") == "not_sent", c("newest.id")).when(c("action") == "bounced", c("decision_id"))
    address = F.when(~done, no).when(c("action") == "send", c("_to")).when(c("action") == "bounced", c("sent_address"))
    return rows.select(*requests.columns, "_v.code", "_v.said", status.alias("status"), reverses.alias("reverses"), address.alias("address"))


def ledger_rows(done: DataFrame) -> DataFrame:
    """What answered requests add to the ledger; of requests for one company at once only the first counts, as each changes its card."""
    first = done.where("status is not null").groupBy("uid").agg(F.min_by(F.struct("id", "status", "reverses", "address"), "id").alias("r"))
    return first.select("uid", "r.status", "r.reverses", "r.address")


def after_bounces(suppression: DataFrame, rows: DataFrame) -> DataFrame:
    """The list of keys (key, reason) after ledger rows: a bounce puts its address on it; only what a bounce put there is taken off, by its undoing (undone_address)."""
    new = rows.where("status = 'bounced' and address is not null").select(F.col("address").alias("key"), F.lit("bounced").alias("reason")).distinct()
    back = rows.where("undone_address is not null").select(F.col("undone_address").alias("key")).distinct().withColumn("_back", F.lit(True))
    kept = suppression.join(back, "key", "left").where("_back is null or reason <> 'bounced'").select("key", "reason")
    return kept.unionByName(new.join(kept, "key", "left_anti"))


def contact_kind(kind: Column, source: Column, name: Column) -> Column:
    """kind/source/named or none: what sort of contact a mail went to, without saying whom."""
    return F.concat_ws("/", kind, source, F.when(F.coalesce(F.trim(name), F.lit("")) != "", "named").otherwise("none"))


def readdressed(contacts: DataFrame, chosen: Column) -> DataFrame:
    """contacts written to at another of their addresses (addresses: array of email and kind), which goes first; unchanged where it isn't offered.

    A person keeps an address of their own only if that one is chosen.
    """
    hit = F.get(F.filter("addresses", lambda a: a["email"] == chosen), F.lit(0))
    first = F.concat(F.array(hit), F.filter("addresses", lambda a: a["email"] != chosen))
    there = hit.isNotNull()
    return contacts.withColumns({"email": F.when(there, chosen).otherwise(F.col("email")), "email_kind": F.when(there, hit["kind"]).otherwise(F.col("email_kind")), "addresses": F.when(there, first).otherwise(F.col("addresses"))})
