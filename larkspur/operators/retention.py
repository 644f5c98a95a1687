"""Erasing companies, and finding those whose data have been held too long."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, urls
from . import commits

Tables = Mapping[str, DataFrame]
HELD = ("contacts", "profiles", "sites", "drafts", "searches")
ERASED = ("contacts", "drafts", "profiles", "sites", "searches", "responses", "progress")
#: Keys of each domain, where its pages meet it in a join.
SALTS = 32
#: Kinds of addresses on a company's own site.
ON_SITE = ("seen", "generic", "constructed")


def held(t: Tables, names: tuple[str, ...] = HELD) -> DataFrame:
    """Companies that any of the tables has rows of."""
    return reduce(DataFrame.union, [t[n].select("uid") for n in names]).distinct()


def stale(t: Tables, cutoff: datetime.date) -> DataFrame:
    """Companies with personal data, without a decision at or after cutoff, and drawn before it.

    Of a company that was never drawn, the newest draft or search counts instead; without a dated row it is stale.
    """
    day = F.lit(cutoff)
    recent = t["ledger"].where(F.col("decided_at") >= day).select("uid").distinct()
    drawn = t["seen"].groupBy("uid").agg(F.max("drawn_at").alias("drawn"))
    dated = t["drafts"].select("uid", F.col("created_at").alias("at")).unionByName(t["searches"].select("uid", F.col("asked_at").alias("at"))).groupBy("uid").agg(F.max("at").alias("touched"))
    rows = held(t).join(recent, "uid", "left_anti").join(drawn, "uid", "left").join(dated, "uid", "left")
    return rows.where(F.coalesce(F.coalesce("drawn", "touched") < day, F.lit(True))).select("uid")


def own_domains(t: Tables, uids: DataFrame) -> DataFrame:
    """The registered domains of companies: of their sites, and of their contacts' addresses on them; never that of an address elsewhere."""
    gone = uids.select("uid").distinct()
    of_sites = t["sites"].join(gone, "uid", "left_semi").select(urls.registered_domain(F.col("url")).alias("domain"))
    mails = t["contacts"].where(F.col("email_kind").isin(*ON_SITE)).join(gone, "uid", "left_semi").select(urls.apex(ids.email_host(F.col("email"))).alias("domain"))
    return of_sites.union(mails).where("domain is not null and domain <> ''").distinct()


def _of_domains(pages: DataFrame, domains: DataFrame, how: str) -> DataFrame:
    """The pages that are, or aren't, of these domains. A domain may have any share of all pages, so each domain's are dealt out over SALTS keys."""
    dealt = pages.withColumns({"domain": urls.registered_domain(F.col("url")), "_salt": F.pmod(F.xxhash64("url"), F.lit(SALTS))})
    found = dealt.join(domains.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["domain", "_salt"], how)
    return found.select(pages.columns)


def erase(t: Tables, uids: DataFrame, reason: str = "erased", clear_addresses: bool = True) -> dict[str, DataFrame]:
    """All tables without the companies' personal rows and the pages of their own sites; their results get another reason, their ledger rows lose the subject and, if asked, the address."""
    gone = uids.select("uid").distinct()
    marked = gone.withColumn("_gone", F.lit(True))
    out = dict(t) | {n: t[n].join(gone, "uid", "left_anti") for n in ERASED}
    redone = lambda df, values: df.join(marked, "uid", "left").withColumns({c: F.when(F.col("_gone"), v).otherwise(F.col(c)) for c, v in values.items()}).select(df.columns)
    none = F.lit(None).cast("string")
    out["results"] = redone(t["results"], {"reason": F.lit(reason)})
    out["ledger"] = redone(t["ledger"], {"subject": none} | ({"address": none} if clear_addresses else {}))
    out["pages"] = _of_domains(t["pages"], own_domains(t, uids), "left_anti")
    return out


def erase_stored(spark: SparkSession, root: str, uids: DataFrame, reason: str = "erased") -> commits.State:
    """Erases companies from the tables stored at root in one commit, and puts their keys on the never-again list; then the older files go."""

    def change(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        changed = {n: df for n, df in erase(t, uids, reason).items() if df is not t[n]}
        return changed | {"suppression": suppress(t["suppression"], forgotten_keys(t, uids))}

    out = commits.update(spark, root, change)
    commits.forget_old(spark, root)
    return out


def erase_plan(t: Tables, uids: DataFrame) -> DataFrame:
    """table_name and n: how many rows of each table an erasure removes."""
    gone = uids.select("uid").distinct()
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    parts = [counted(t[n].join(gone, "uid", "left_semi"), n) for n in ERASED]
    return reduce(DataFrame.unionByName, [*parts, counted(_of_domains(t["pages"], own_domains(t, uids), "left_semi"), "pages")])


def forgotten_keys(t: Tables, uids: DataFrame) -> DataFrame:
    """kind and key of what goes on the never-again list with forgotten companies: their numbers, the addresses they were written to, and the profiles of their links."""
    gone = uids.select("uid").distinct()
    mailed = t["ledger"].where("status = 'sent' and address is not null").join(gone, "uid", "left_semi").select(F.lit("address").alias("kind"), ids.address_key(F.col("address")).alias("key"))
    linked = t["profiles"].join(gone, "uid", "left_semi").select(F.lit("profile").alias("kind"), ids.profile_key(F.col("profile")).alias("key"))
    return gone.select(F.lit("uid").alias("kind"), F.col("uid").cast("string").alias("key")).union(mailed).union(linked).distinct()


def held_facts(t: Tables, uids: DataFrame) -> DataFrame:
    """kind (person or address) and value of all that rows of companies hold: of contacts, links and the ledger."""
    of = lambda name, column, kind: t[name].join(uids.select("uid").distinct(), "uid", "left_semi").select(F.lit(kind).alias("kind"), F.col(column).alias("value"))
    parts = [of("contacts", "person", "person"), of("invites", "person", "person"), of("contacts", "email", "address"), of("ledger", "address", "address")]
    return reduce(DataFrame.union, parts).where("value is not null").distinct()


def suppress(suppression: DataFrame, keys: DataFrame) -> DataFrame:
    """The list (kind, key and what else it has, or uid) with the new keys (the same, or kind and key); those on it already stay as they are.

    kind is uid, address or profile. A list by uid is read as one of kind uid, whose uid column stays.
    """
    if "key" not in keys.columns:
        keys = keys.select(F.lit("uid").alias("kind"), F.col("uid").cast("string").alias("key"))
    listed = suppression if "key" in suppression.columns else suppression.select("*", F.lit("uid").alias("kind"), F.col("uid").cast("string").alias("key"))
    new = keys.select("kind", "key").distinct().join(listed, ["kind", "key"], "left_anti")
    if "uid" in listed.columns:
        new = new.withColumn("uid", F.when(F.col("kind") == "uid", F.col("key").try_cast(listed.schema["uid"].dataType)))
    return listed.unionByName(new, allowMissingColumns=True)
