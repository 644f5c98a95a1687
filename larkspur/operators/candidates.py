"""Choosing among candidates: sites, pages, addresses, notices, and a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_sites(results: DataFrame, groups: list[str]) -> DataFrame:
    """One site for each domain of a group: the rank of its first result, the url of the first on its apex host, or else the first.

    results: pos, url, host, domain.
    """
    apex = F.regexp_replace("host", "^www\\.", "") == F.col("domain")
    return results.groupBy(*groups, "domain").agg(F.min("pos").alias("pos"), F.min_by("url", F.struct((~apex).alias("a"), "pos")).alias("url"))


def pruned(pages: DataFrame, groups: list[str], most: int) -> DataFrame:
    """At most so many pages of a group: pages of their own first, those nearest the root and then the shortest first; bulk pages, as they came, fill what is left.

    pages: pos, url, path, bulk.
    """
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("bulk", F.when(~F.col("bulk"), depth), F.when(~F.col("bulk"), F.length("url")), "pos"))
    return pages.withColumn("rank", rank).where(F.col("rank") <= most)


def first_of_kind(pages: DataFrame, groups: list[str]) -> DataFrame:
    """The first page of each kind. pages: pos, url, kind (null: none)."""
    return pages.where("kind is not null").groupBy(*groups, "kind").agg(F.min_by("url", "pos").alias("url"))


def current_notices(notices: DataFrame) -> DataFrame:
    """name, pos and what else there is of the people that a register still names. notices: name, published, pos, departed.

    The newest day that names somebody decides: if an entry of it has them as not departed, the first such stays, else they are gone.
    """
    newest = notices.withColumn("_r", F.rank().over(Window.partitionBy("name").orderBy(F.col("published").desc()))).where("_r = 1 and not departed")
    return newest.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("pos"))).where("_k = 1").drop("_r", "_k")


def validated_scores(answers: DataFrame, asked: DataFrame, least: int = 0, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Answers that count (for each company asked about the first that is in range), and companies to ask about again. answers: pos, uid, score."""
    known = answers.where(F.col("score").between(least, most)).join(asked.select("uid"), "uid", "left_semi")
    good = known.withColumn("_k", F.row_number().over(Window.partitionBy("uid").orderBy("pos"))).where("_k = 1").drop("_k")
    return good, asked.join(good.select("uid"), "uid", "left_anti")


def decision_metrics(judged: DataFrame) -> DataFrame:
    """precision, recall and hits of a choice (chosen, deserved: booleans)."""
    hits, chosen, deserved = (F.count_if(F.expr(c)) for c in ("chosen and deserved", "chosen", "deserved"))
    return judged.agg(hits.alias("hits"), F.round(F.try_divide(hits, chosen), 6).alias("precision"), F.round(F.try_divide(hits, deserved), 6).alias("recall"))


def trial_metrics(scores: DataFrame, k: int) -> DataFrame:
    """bias, mae, exact matches, and how many of the k best of both sides agree (ties by uid). scores: uid, score, human."""
    top = lambda by, name: scores.orderBy(F.col(by).desc(), "uid").limit(k).agg(F.collect_set("uid").alias(name))
    off = F.col("score") - F.col("human")
    sums = scores.agg(F.round(F.avg(off), 6).alias("bias"), F.round(F.avg(F.abs(off)), 6).alias("mae"), F.count_if(off == 0).alias("exact"))
    return sums.join(top("score", "a")).join(top("human", "b")).select("bias", "mae", "exact", F.size(F.array_intersect("a", "b")).cast("long").alias("top_overlap"))
