"""Breadth-first walks of many sites at once: each round is a join of all sites' edges, written before the next begins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared

#: Of an index's nested sitemaps so many are followed.
NESTED = 20


def _kept(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows as they are stored at path; what is there whole isn't made again."""
    if not shared.there(spark, f"{path}/_SUCCESS"):
        shared.remove(spark, path)
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sitemap_pages(sites: DataFrame, maps: DataFrame, homes: DataFrame, limit: int, root: str) -> DataFrame:
    """site, n and url of the pages that each site's sitemaps list, in the order of a walk from its first one, and the site itself last.

    sites: site, start (its first sitemap); maps: url, pages and nested (arrays) of sitemaps that could be read; homes: site and links of home pages. No sitemap is read twice for a site, of an
    index's nested ones NESTED are followed, and a site's walk ends when ten times limit pages are found (the feature). A site without any takes its home page's links. Sitemaps are read in the order in
    which they were met, so which one is the last to be read is the same as in a walk of one site after the other.

    What maps says is stored once, as each round joins it. Rounds go on until no site has anything left; each is stored under root, a folder that driver and executors share, where a walk that broke off goes on.
    """
    spark, most = sites.sparkSession, 10 * limit
    edge, tried, k = sites.select("site", F.col("start").alias("url"), F.lit(1).alias("seq")), [], 0
    maps = _kept(spark, f"{root}/maps", maps.select("url", "pages", "nested"))
    within = Window.partitionBy("site").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        new = edge.groupBy("site", "url").agg(F.min("seq").alias("seq"))
        had = None
        if tried:
            past = reduce(DataFrame.unionByName, tried)
            new = new.join(past.select("site", "url"), ["site", "url"], "left_anti")
            had = past.where("read").groupBy("site").agg(F.sum(F.size("pages")).alias("had"))
        met = new.join(maps.select("url", "pages", "nested"), "url", "left")
        met = met.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("pages", "nested")})
        met = met.join(had, "site", "left") if had is not None else met.withColumn("had", F.lit(0))
        before = F.coalesce("had", F.lit(0)) + F.coalesce(F.sum(F.size("pages")).over(within), F.lit(0))
        met = met.withColumn("read", before < most).select("site", "url", F.lit(k).alias("round"), "seq", "read", "pages", "nested")
        done = _kept(spark, f"{root}/round-{k}", met)
        if done.isEmpty():
            break
        tried.append(done)
        nested = done.where("read").select("site", "seq", F.posexplode(F.slice("nested", 1, NESTED)).alias("at", "url"))
        edge = nested.select("site", "url", F.row_number().over(Window.partitionBy("site").orderBy("seq", "at")).alias("seq"))
        k += 1
    found = reduce(DataFrame.unionByName, tried) if tried else done
    pages = found.where("read").select("site", F.col("round").cast("long").alias("a"), F.col("seq").cast("long").alias("b"), F.posexplode("pages").alias("c", "url"))
    without = sites.select("site").distinct().join(pages.select("site").distinct(), "site", "left_anti")
    links = homes.join(without, "site", "left_semi").select("site", F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.posexplode("links").alias("c", "url"))
    own = sites.select("site").distinct().select("site", F.lit((1 << 62)).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c"), F.col("site").cast("string").alias("url"))
    every = pages.unionByName(links).unionByName(own)
    return every.select("site", F.row_number().over(Window.partitionBy("site").orderBy("a", "b", "c")).alias("n"), "url")


def reached(links: DataFrame, start: DataFrame, most: int | None, root: str) -> DataFrame:
    """url and depth of pages that links (source, target) reach from start (url), none twice, until a round after which most are found (None: all). Rounds are stored under root."""
    spark, edge, seen, k, n = start.sparkSession, start.select("url").distinct(), [], 0, 0
    while True:
        done = _kept(spark, f"{root}/depth-{k}", edge.select("url", F.lit(k).alias("depth")))
        more = done.count()
        if more or not seen:
            seen.append(done)
        n, k = n + more, k + 1
        if not more or (most is not None and n >= most):
            return reduce(DataFrame.unionByName, seen)
        known = reduce(DataFrame.unionByName, seen).select("url")
        edge = done.select(F.col("url").alias("source")).join(links.select("source", F.col("target").alias("url")), "source").select("url").distinct().join(known, "url", "left_anti")
