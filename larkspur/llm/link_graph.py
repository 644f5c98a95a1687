"""URL filters: rules on hosts and paths, and trust and distrust over the links between hosts, all in DataFrame operations.

Trust is a personalised PageRank from hosts that rules allow, along links; distrust one from hosts that rules block,
against them, so that it reaches hosts that link to blocked ones. Both are taken as the seeds' contributions to a host, that is, by the host's own links: a host's distrust is what blocked hosts get of
the PageRank that starts at it, its trust what trusted ones get of the one that starts at it against the links. So what a host has doesn't hang on how many others link to the same seed. A
page without a rule is blocked if its host's distrust is above a threshold and above its trust.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The name or verdict of the longest rule that fits; null if none does."""
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(getattr(r, field)))
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """source, target and n (pages of source with a link to target) for links between different hosts. pages: host, html."""
    targets = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), x))), lambda h: h != ""))
    linked = pages.select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return linked.where("source <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, close: float = 1e-4, contributions: bool = False) -> DataFrame:
    """kind, host, rank and gain (what of the rank came by links). seeds: kind (trust or distrust), host, weight.

    A host shares its rank among the hosts that its links (against them: that link to it) lead to; the weights of a kind sum to one, and what reaches a host without such links goes back to the seeds. With
    contributions, a host has instead the mean of the ranks of the hosts that it links to (for trust: that link to it), less what damping takes, besides its weight: the sum over seeds of how much of
    the PageRank personalised to the host they get. Then weights are as they are, and no rank is over 1 / (1 - damping) times the largest.
    Rounds end when the ranks of a kind have moved by less than close in all, or, with contributions, no rank by more,
    which a round's share of damping brings about after log(close / 2) / log(damping) rounds at the latest; each is written to the shared folder, and the driver sees a number.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "n"))
    by = ["kind", "to" if contributions else "from"]
    whole = both.groupBy(*by).agg(F.sum("n").alias("all"))
    arcs = staged(both.join(whole, by).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("share")), "arcs")
    rank = staged(seeds.select("kind", "host", F.col("weight").alias("rank"), "weight"), "ranks")
    if arcs.isEmpty():
        return rank.select("kind", "host", "rank", F.lit(0.0).alias("gain"))
    off = F.abs(F.col("rank") - F.col("old"))
    for _ in range(math.ceil(math.log(close / 2) / math.log(damping))):
        moved = arcs.join(rank.withColumnRenamed("host", "from"), ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("gain"))
        kept = moved.groupBy("kind").agg(F.sum("gain").alias("kept"))
        new = moved.select("kind", "host", "gain", F.lit(0.0).alias("weight"), F.lit(0.0).alias("old")).unionByName(rank.select("kind", "host", F.lit(0.0).alias("gain"), "weight", F.col("rank").alias("old")))
        new = new.groupBy("kind", "host").agg(F.sum("gain").alias("gain"), F.sum("weight").alias("weight"), F.sum("old").alias("old"))
        if contributions:
            new = new.select("kind", "host", (F.col("gain") + F.col("weight")).alias("rank"), "gain", "weight", "old")
        else:
            new = new.join(F.broadcast(kept), "kind", "left").select("kind", "host", (F.col("gain") + (1 - F.coalesce("kept", F.lit(0.0))) * F.col("weight")).alias("rank"), "gain", "weight", "old")
        new = staged(new, "ranks")
        change = max((r["moved"] for r in new.groupBy("kind").agg((F.max(off) if contributions else F.sum(off)).alias("moved")).collect()), default=0.0)
        drop_staged(rank)
        at = new.staged_at
        rank = new.drop("old")
        rank.staged_at = at
        if change < close:
            break
    drop_staged(arcs)
    return rank.select("kind", "host", "rank", "gain")


def blocked_hosts(pages: DataFrame, rules: tuple[Rule, ...], seed_share: float = 0.5, threshold: float = 0.05) -> DataFrame:
    """host, of hosts whose distrust is over threshold and over their trust. pages: host, path, html.

    A host is a seed if rules that allow, or rules that block, decide any of its pages, and weighs as much as their share of
    them. A host all of whose links lead to a wholly blocked host has a distrust of 0.85, one with a twentieth of them there a twentieth of that, whatever the number of
    seeds and of other hosts that link there. What comes by links counts; what
    a host has from its own pages does only if they are more than seed_share of them, as the rest of its pages may differ.
    """
    verdict = rule_of(F.col("host"), F.col("path"), rules, "verdict")
    shares = pages.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce(verdict, F.lit("")) == "allow").cast("int")).alias("trust"), F.avg((F.coalesce(verdict, F.lit("")) == "block").cast("int")).alias("distrust"))
    seeds = shares.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "share")).where(F.col("share") > 0)
    seeds = staged(seeds.select("kind", "host", "share"), "seeds")
    ranks = propagate(host_links(pages), seeds.withColumnRenamed("share", "weight"), contributions=True)
    ranks = ranks.join(seeds, ["kind", "host"], "left").withColumn("rank", F.when(F.col("share") > seed_share, F.col("rank")).otherwise(F.col("gain")))
    rank = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(rank("trust"), rank("distrust")).where((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))).select("host")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url, html; other columns are left out).

    The longest rule that fits decides. Else the page's host does, by links; a url that is null or has no :// has an empty host
    and path, no rule, and is allowed. A null html has no links. Rows that repeat are judged each for itself, and count each as a
    page of their host; an empty table gives no rows.
    """
    host, path = F.col("host"), F.col("path")
    parted = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    blocked = blocked_hosts(parted, rules).withColumn("bad", F.lit(True))
    rule, verdict = rule_of(host, path, rules, "name"), rule_of(host, path, rules, "verdict")
    found = parted.drop("html").join(blocked, "host", "left")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
