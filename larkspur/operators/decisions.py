"""Verdicts on records, each an ordered list of rules of which the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, urls


def recommend(site: Column, distributor: Column, foreign: Column, name: Column, email: Column, kind: Column, source: Column) -> Column:
    """recommendation (send, hold or skip) and reason."""
    who = F.coalesce(name, F.lit("nobody named"))
    true = lambda c: F.coalesce(c, F.lit(False))
    say = lambda verdict, *said: F.struct(F.lit(verdict).alias("recommendation"), F.concat(*(s if isinstance(s, Column) else F.lit(s) for s in said)).alias("reason"))
    # fixed values: the reasons, in their order
    rules = [
        (site.isNull(), say("skip", "no website of its own was found")),
        (true(distributor), say("skip", "its site says it resells what others make")),
        (true(foreign), say("skip", "its site belongs to a foreign parent group")),
        (email.isNull() & name.isNull() & source.isNull(), say("hold", "nobody is named and no address is published")),
        (email.isNull() & name.isNull(), say("hold", "no address and nobody named; only a LinkedIn lead to check")),
        (email.isNull(), say("hold", name, " is named (", source, ") but no address")),
        (kind == "third_party", say("hold", "the only address, ", email, ", is on another domain")),
        (kind == "seen", say("send", who, " at their own address on the company's site")),
        (kind == "generic", say("send", who, " at the general inbox the site publishes")),
    ]
    return F.coalesce(*(F.when(c, x) for c, x in rules), say("send", who, " at info@ on the site's domain — not seen, a guess"))


def send_block(cards: DataFrame) -> DataFrame:
    """Why a card must not be sent, the first reason that holds; null if it may. cards has a boolean column for each reason but the draft's.

    The draft's problems have three states: null was never checked, empty passed.
    """
    problems = F.col("problems")
    rules = {
        "decided": F.col("decided"), "suppressed": F.col("suppressed"), "no draft": F.col("body").isNull(), "old frame": F.col("old_frame"), "unchecked": problems.isNull(), "failed": F.size(problems) > 0,
        "no address": F.col("email").isNull(), "contact changed": F.col("drifted"), "not approved": ~F.col("approved"), "placeholder link": F.col("placeholder_link"), "foreign link": F.col("foreign_link"),
    }
    return cards.withColumn("blocked", F.coalesce(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def site_tier(uid: Column, street: Column, place: Column, page: Column) -> Column:
    """What ties a page to a company: its number, else its address (postcode and town, and the street if known), else nothing."""
    low = F.lower(page)
    at = low.contains(F.lower(place)) & (street.isNull() | low.contains(F.lower(street)))
    return F.when(ids.uid_match(uid, page) == "match", "uid").when(F.coalesce(at, F.lit(False)), "address").otherwise("none")


def chosen_site(chosen: Column, offered: Column, quote: Column, page: Column, tier: Column) -> Column:
    """The url that a model chose, if it was offered and its quotation stands on the page, and what vouches for it."""
    sound = F.array_contains(offered, chosen) & text.quote_found(quote, page)
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(chosen.alias("url"), F.when(tier == "none", "model").otherwise(tier).alias("tier")))


def checked_people(people: Column, haystack: Column, company: Column, site: Column) -> Column:
    """People whose names stand in the pages and are persons'; addresses that don't stand there, or that nobody reads, are blanked, and those of other domains marked.

    people: array of name, role, email; haystack and company are normalised, and so are names (text.normalised) beforehand.
    """
    there = lambda x: F.coalesce((F.trim(x) != "") & haystack.contains(x), F.lit(False))
    real = F.filter(people, lambda p: there(p["name"]) & text.names_a_person(p["name"], company, p["role"].isNull()))
    email = lambda p: F.when(there(p["email"]) & ~text.is_noise(p["email"]), p["email"])
    return F.transform(real, lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"), email(p).alias("email"), F.coalesce(urls.apex(ids.email_host(email(p))) != site, F.lit(False)).alias("offsite")))


def contact_choice(own: Column, at_inbox: Column, offsite: Column, guessed: Column, registered: Column, inbox: Column, lead: Column) -> Column:
    """The best contact that there is: the first of a person's own address on the site, one named at the site's inbox, one on another domain,
    one at a guessed inbox, one that the register names, the inbox alone, a lead."""
    return F.coalesce(own, at_inbox, offsite, guessed, registered, inbox, lead)


def invite_problems(company: Column, channel: Column, suppressed: Column, taken: Column, most: int = 200) -> Column:
    """What stands against a personal link, in order."""
    rules = {"company missing": F.coalesce(F.trim(company) == "", F.lit(True)), "too long": F.length(company) > most, "unknown channel": ~F.coalesce(channel.isin("linkedin", "mail", "phone", "event"), F.lit(False)), "suppressed": suppressed, "profile has a link": taken}
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
