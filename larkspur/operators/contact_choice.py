"""Whom to write to: of the people, addresses and notices found for each company, the contact that the rules prefer, and every other address that a card may offer.

Somebody whom the site names goes before whom the register names; among those of the site one with an own address on it goes first, then who runs the company, then who chairs its board. A
named person without an own address is written to at the inbox that the site publishes, or else at info@ on the site's own domain. Nobody named: the inbox alone, never a guessed one. An address on another domain is kept and marked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, urls
from . import sites
from .candidates import current_notices

MOST_OFFERED = 8
_ADDRESS = "array<struct<email: string, kind: string, note: string>>"


def addresses_of(pages: DataFrame, emails: Column) -> DataFrame:
    """uid, at (their order), email and url of the addresses of each company's pages (uid, pos, url, text), each with the first page that has it."""
    each = pages.select("uid", "pos", "url", F.posexplode(emails).alias("place", "email"))
    first = each.groupBy("uid", "email").agg(F.min(F.struct("pos", "place", "url")).alias("x"))
    return first.select("uid", F.struct("x.pos", "x.place").alias("at"), "email", F.col("x.url").alias("url"))


def _page_with(pages: DataFrame, rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (uid and what else) with the first of the company's pages whose text holds a value."""
    wanted = rows.select("uid", F.lower(F.col(value)).alias("_v")).where("_v <> ''")
    found = pages.select("uid", "pos", "url", F.lower("text").alias("_t")).join(wanted, "uid").where(F.col("_t").contains(F.col("_v")))
    return rows.join(found.groupBy("uid").agg(F.min_by("url", "pos").alias(name)), "uid", "left")


def contact_choice(companies: DataFrame, people: DataFrame, pages: DataFrame, notices: DataFrame, leads: DataFrame, emails: Callable[[Column], Column] = text.page_addresses, domain: Callable[[Column], Column] = urls.registered_domain, inbox: Callable[[Column], Column] = urls.inbox_domain, apex: Callable[[Column], Column] = urls.apex) -> DataFrame:
    """uid, name, role, email, email_kind, source, source_url, source_date, alternatives, lead and addresses of the contact of each company that has one.

    companies: uid, site (a url); people: uid, pos, name, role, email, of the site's people as they are checked; pages: uid, pos, url, text; notices: uid, pos, name, role, published, departed, url, of persons in the register,
    asked only where the site names nobody who can be greeted; leads: uid, url of profiles found by a search, taken where no address was seen.
    """
    site = companies.select("uid", "site", domain(F.col("site")).alias("domain"), inbox(F.col("site")).alias("guess"))
    on_site = lambda e: F.coalesce((apex(ids.email_host(e)) == F.col("domain")) | urls.other_ending(F.regexp_replace(ids.email_host(e), r"^www\.", ""), F.col("domain")), F.lit(False))
    seen = addresses_of(pages, emails(F.col("text"))).join(site.select("uid", "domain"), "uid")
    kind = F.when(~on_site(F.col("email")), "third_party").when(F.regexp_extract("email", "^([^@]*)", 1).isin(*sites.GENERIC), "generic").otherwise("seen")
    note = F.when((kind != "third_party") & urls.other_ending(apex(ids.email_host(F.col("email"))), F.col("domain")), F.concat(F.lit("the site's name under another ending than "), "domain"))
    listed = seen.select("uid", F.struct("at", "email", "url", kind.alias("kind"), note.alias("note")).alias("a")).groupBy("uid").agg(F.sort_array(F.collect_list("a")).alias("listed"))
    first = lambda k: F.get(F.filter("listed", lambda a: a["kind"] == k), F.lit(0))
    base = site.join(listed, "uid", "left").withColumns({"inbox": first("generic"), "offsite": first("third_party")})

    named = people.where(text.can_be_addressed(F.col("name"))).join(site.select("uid", "domain"), "uid").withColumn("offsite", F.coalesce(apex(ids.email_host(F.col("email"))) != F.col("domain"), F.lit(False)))
    order = F.struct((F.col("email").isNull() | F.col("offsite")).alias("a"), text.role_rank(F.col("role")).alias("b"), "pos", "name", "role", "email", "offsite")
    ranked = named.groupBy("uid").agg(F.sort_array(F.collect_list(order)).alias("r"))
    greeted = notices.join(ranked.select("uid"), "uid", "left_anti")
    current = current_notices(greeted.withColumn("person", F.col("name")).withColumn("name", F.concat_ws("\x00", F.col("uid").cast("string"), "name")))
    by_rank = F.struct(text.role_rank(F.col("role")).alias("b"), (-F.unix_date("published")).alias("d"), "pos", F.col("person").alias("name"), "role", "published", "url")
    registered = current.groupBy("uid").agg(F.sort_array(F.collect_list(by_rank)).alias("n"))

    rows = base.join(ranked, "uid", "left").join(registered, "uid", "left")
    p, n = F.get("r", F.lit(0)), F.get("n", F.lit(0))
    rows = rows.withColumns({"p": p, "n1": n}).withColumns({"name": F.coalesce("p.name", "n1.name"), "role": F.when(F.col("p").isNotNull(), F.col("p.role")).otherwise(F.col("n1.role")), "own": F.when(~F.col("p.offsite"), F.col("p.email"))})
    rows = _page_with(pages, rows, "own", "_own_at")
    rows = _page_with(pages, rows.withColumn("_site_name", F.col("p.name")), "_site_name", "_name_at")
    found_at = F.coalesce("_name_at", "site")
    on_pages, in_register = F.col("p").isNotNull(), F.col("n1").isNotNull()
    guessed = F.when(F.col("guess").isNotNull(), F.concat(F.lit("info@"), "guess"))
    pick = lambda email, kind, url: F.struct(email.alias("email"), kind.alias("email_kind"), url.alias("source_url"))
    lit = F.lit
    none = lit(None).cast("string")
    c = F.col
    choice = (
        F.when(on_pages & c("own").isNotNull(), pick(c("own"), lit("seen"), F.coalesce("_own_at", found_at)))
        .when(on_pages & c("inbox").isNotNull(), pick(c("inbox.email"), lit("generic"), c("inbox.url")))
        .when(on_pages & c("p.email").isNotNull(), pick(c("p.email"), lit("third_party"), found_at))
        .when(on_pages, pick(guessed, F.when(c("guess").isNotNull(), "constructed"), found_at))
        .when(in_register & c("inbox").isNotNull(), pick(c("inbox.email"), lit("generic"), c("n1.url")))
        .when(in_register, pick(guessed, F.when(c("guess").isNotNull(), "constructed"), c("n1.url")))
        .when(c("inbox").isNotNull(), pick(c("inbox.email"), lit("generic"), c("inbox.url")))
        .when(c("offsite").isNotNull(), pick(c("offsite.email"), lit("third_party"), c("offsite.url")))
        .otherwise(pick(none, none, none))
    )
    others = F.when(on_pages, F.transform(F.slice("r", 2, 1 << 30), lambda x: sites.described(x["name"], x["role"], x["email"]))).when(in_register, F.transform(F.slice("n", 2, 1 << 30), lambda x: sites.described(x["name"], x["role"], none)))
    rows = rows.withColumn("c", choice).withColumn("alternatives", F.coalesce(others, F.array().cast("array<string>")))
    unseen = F.col("c.email_kind").isNull() | (F.col("c.email_kind") == "constructed")
    rows = rows.join(leads.groupBy("uid").agg(F.min("url").alias("_lead")), "uid", "left").withColumn("lead", F.when(unseen, F.col("_lead")))
    there = on_pages | in_register | F.col("c.email").isNotNull() | F.col("lead").isNotNull()
    chosen = F.when(F.col("c.email").isNotNull() & F.col("c.email_kind").isNotNull(), F.array(F.struct(F.col("c.email").alias("email"), F.col("c.email_kind").alias("kind"), F.when((F.col("c.email_kind") != "third_party") & urls.other_ending(apex(ids.email_host(F.col("c.email"))), F.col("domain")), F.concat(F.lit("the site's name under another ending than "), "domain")).alias("note")))).otherwise(F.array().cast(_ADDRESS))
    rest = F.transform(F.filter(F.coalesce("listed", F.array()), lambda a: ~F.coalesce(a["email"] == F.col("c.email"), F.lit(False))), lambda a: F.struct(a["email"].alias("email"), a["kind"].alias("kind"), a["note"].alias("note")))
    source = F.when(on_pages, "site").when(in_register, "shab").otherwise("site")
    return rows.where(there).select("uid", "name", "role", "c.email", "c.email_kind", source.alias("source"), "c.source_url", F.when(~on_pages & in_register, F.col("n1.published")).alias("source_date"), "alternatives", "lead", F.slice(F.concat(chosen, rest), 1, MOST_OFFERED).alias("addresses"))
