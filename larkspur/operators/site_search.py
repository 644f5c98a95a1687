"""The search for companies' sites as a table of states: each superstep moves all companies that stand at it, and what it leaves is written before the next begins.

A company is asked about (three queries), and where a query fails the second provider, if there is one, answers it. Silence from all of them is no answer:
the second provider is asked, or all is asked again, and silence then is an error. Where only directories came back, one narrower query follows. Guessed domains that
resolve go before what was found; of each registered domain one page is a candidate, and so many of them are read. A chooser picks among those with text. "No website" needs the
second provider's answer to the first query, if there is one.

What is outside comes as functions between DataFrames: ask, read and choose. None is called for a company that doesn't need it. States are never sent whole to every task:
as files they are small enough for that, as rows they aren't.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import shared
from . import candidates as among
from . import sites

STATE = """uid long, step string, queries array<string>, narrowing string, previous_error string, guesses array<string>, found array<struct<pos: int, url: string, provider: string>>,
    answered array<string>, candidates array<string>, n_candidates int, site string, verdict string, reason string"""
#: The supersteps, in order; a company stands at the one it goes through next, or at done.
STEPS = ("ask", "silent", "narrow", "read", "confirm", "reread", "conclude")
FIRST, SECOND = "first", "second"
SILENT = "every query returned nothing, twice; search was probably throttled"
REFUSED = "every candidate refused"


class Outside(NamedTuple):
    """ask: (uid, query, provider) to (uid, query, provider, error, urls), a row for each; read: (uid, url) to (uid, url, text, refused, lasting, final);
    choose: (uid, url, text) to (uid, url), a row a company at most. second: whether there is a second provider. blocked: domains of directories; domain: the registered domain of a url."""

    ask: Callable[[DataFrame], DataFrame]
    read: Callable[[DataFrame], DataFrame]
    choose: Callable[[DataFrame], DataFrame]
    second: bool = False
    blocked: tuple[str, ...] = ()
    most: int = 5
    domain: Callable[[Column], Column] = urls.registered_domain
    root: Callable[[Column], Column] = urls.site_root


def begun(companies: DataFrame) -> DataFrame:
    """States at the first step. companies: uid, queries, narrowing, previous_error, guesses (those that resolve)."""
    nothing = {"step": F.lit("ask"), "found": F.array(), "answered": F.array(), "candidates": F.array(), "n_candidates": F.lit(0), "site": F.lit(None), "verdict": F.lit(None), "reason": F.lit(None)}
    rows = companies.withColumns(nothing)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.sparkSession.createDataFrame([], STATE).schema))


def _asked(rows: DataFrame, queries: Column, out: Outside, provider: str = FIRST) -> DataFrame:
    """rows with found and answered longer by what came back, n_new, and failure, the text of a query that nobody answered."""
    wanted = rows.select("uid", F.posexplode(queries).alias("at", "query")).withColumn("provider", F.lit(provider))
    said = out.ask(wanted.select("uid", "query", "provider"))
    told = shared.met(wanted, said, ["uid", "query", "provider"], "left")
    if provider == FIRST and out.second:
        failed = told.where("error is not null").select("uid", "at", "query", F.lit(SECOND).alias("provider"))
        told = told.where("error is null").unionByName(shared.met(failed, out.ask(failed.select("uid", "query", "provider")), ["uid", "query", "provider"], "left"))
    listed = told.withColumn("urls", F.when(F.col("error").isNull(), F.coalesce("urls", F.array().cast("array<string>"))))
    each = listed.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("at", "provider", "urls"))).alias("told"), F.array_sort(F.collect_list(F.when((F.col("provider") == SECOND) & F.col("error").isNull(), F.col("query")))).alias("by_second"),
        F.min(F.when(F.col("error").isNotNull(), F.concat("query", F.lit(": "), "error"))).alias("failure"),
    )
    one = lambda t: F.transform(F.coalesce(t["urls"], F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), t["provider"].alias("provider")))
    new = F.coalesce(F.flatten(F.transform("told", one)), F.array().cast("array<struct<url: string, provider: string>>"))
    numbered = F.transform("new", lambda x, i: F.struct((F.size("found") + i).cast("int").alias("pos"), x["url"].alias("url"), x["provider"].alias("provider")))
    both = shared.met(rows, each, "uid", "left").withColumn("new", new).withColumn("n_new", F.size("new"))
    both = both.withColumn("found", F.concat("found", numbered)).withColumn("answered", F.array_union("answered", F.coalesce("by_second", F.array().cast("array<string>"))))
    return both.drop("told", "by_second", "new")


def _moved(rows: DataFrame, step: Column, verdict: Column | None = None, reason: Column | None = None) -> DataFrame:
    rows = rows.withColumn("step", step)
    if verdict is not None:
        rows = rows.withColumns({"verdict": verdict, "reason": reason})
    return rows


def _failed(rows: DataFrame, next_: Column) -> DataFrame:
    """rows moved on, or ended by the query that nobody answered."""
    bad = F.col("failure").isNotNull()
    return _moved(rows, F.when(bad, "done").otherwise(next_), F.when(bad, "error"), F.when(bad, F.concat(F.lit("search failed: "), "failure")))


def _pages(rows: DataFrame, found: Column, out: Outside) -> DataFrame:
    """uid, pos, url and domain of one page of each domain that isn't a directory's."""
    each = rows.select("uid", F.explode(found).alias("r")).select("uid", F.col("r.pos").alias("pos"), F.col("r.url").alias("url"))
    # exploded, so that what filters it doesn't derive the domain anew for each blocked one
    each = each.select("uid", "pos", "url", F.explode(F.array(out.domain(F.col("url")))).alias("domain")).where("domain is not null").withColumn("host", urls.host(F.col("url")))
    blocked = F.array(*map(F.lit, out.blocked)).cast("array<string>")
    fits = each.where(~F.exists(blocked, lambda b: (F.col("domain") == b) | F.col("domain").endswith(F.concat(F.lit("."), b))))
    return among.dedupe_sites(fits, ["uid"])


def _read(rows: DataFrame, out: Outside) -> DataFrame:
    """rows with site chosen among candidates, every (all of them refused, for good or for now), and why they did."""
    wanted = rows.select("uid", F.posexplode("candidates").alias("at", "url"))
    said = shared.met(wanted, out.read(wanted.select("uid", "url")), ["uid", "url"])
    outcome = sites.refusals(said.select("uid", "url", "refused", "lasting")).select("uid", "outcome", "reasons")
    moved = F.when(F.coalesce(out.domain(F.col("final")) != out.domain(F.col("url")), F.lit(False)), out.root(F.col("final"))).otherwise(F.col("url"))
    texts = said.where("refused is null and trim(text) <> ''").select("uid", "at", moved.alias("url"), "text")
    chosen = out.choose(texts).select("uid", F.col("url").alias("_site"))
    return shared.met(shared.met(rows, outcome, "uid", "left"), chosen, "uid", "left").withColumn("site", F.coalesce("site", "_site")).drop("_site")


def _ask(rows: DataFrame, out: Outside) -> DataFrame:
    return _failed(_asked(rows, F.col("queries"), out), F.when(F.col("n_new") == 0, "silent").otherwise("narrow"))


def _silent(rows: DataFrame, out: Outside) -> DataFrame:
    if out.second:
        unheard = F.filter(F.slice("queries", 1, 2), lambda q: ~F.array_contains("answered", q))
        return _failed(_asked(rows, unheard, out, SECOND), F.lit("narrow"))
    rows = _failed(_asked(rows, F.col("queries"), out), F.lit("narrow"))
    still = (F.col("n_new") == 0) & F.col("verdict").isNull()
    return _moved(rows, F.when(still, "done").otherwise(F.col("step")), F.when(still, "error").otherwise(F.col("verdict")), F.when(still, SILENT).otherwise(F.col("reason")))


def _narrow(rows: DataFrame, out: Outside) -> DataFrame:
    some = _pages(rows, F.col("found"), out).select("uid").distinct()
    fine = shared.met(rows, some, "uid", "left_semi").withColumn("step", F.lit("read"))
    bare = _failed(_asked(shared.met(rows, some, "uid", "left_anti"), F.array("narrowing"), out), F.lit("read"))
    return fine.unionByName(bare.drop("n_new", "failure"))


def _candidates(rows: DataFrame, found: Column, out: Outside) -> DataFrame:
    """rows with candidates: of each domain of found one page, the first most of them."""
    listed = _pages(rows, found, out).groupBy("uid").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "url"))), 1, out.most).alias("_c"))
    return shared.met(rows, listed, "uid", "left").withColumn("candidates", F.coalesce(F.transform("_c", lambda c: c["url"]), F.array().cast("array<string>"))).drop("_c")


def _first_read(rows: DataFrame, out: Outside) -> DataFrame:
    guesses = F.transform("guesses", lambda g, i: F.struct((i - F.size("guesses")).cast("int").alias("pos"), g.alias("url"), F.lit("guess").alias("provider")))
    rows = rows.withColumn("found", F.concat(guesses, "found"))
    rows = _read(_candidates(rows, F.col("found"), out).withColumn("n_candidates", F.size("candidates")), out)
    return _refusal(rows, F.when(F.col("site").isNotNull(), "conclude").otherwise("confirm"))


def _refusal(rows: DataFrame, next_: Column) -> DataFrame:
    """rows moved on; those all of whose candidates refused end: in an error, or, where they refuse for good and did before, with no site."""
    known = F.coalesce("outcome", F.lit("read"))
    verdict = F.when((known == REFUSED) & F.coalesce(F.col("previous_error").startswith(REFUSED), F.lit(False)), "skip").when(known != "read", "error")
    reason = F.when(known != "read", F.concat(F.when(known == REFUSED, REFUSED).otherwise("no candidate site could be read"), F.lit(" ("), "reasons", F.lit(")")))
    return _moved(rows, F.when(verdict.isNotNull(), "done").otherwise(next_), verdict, reason)


def _confirm(rows: DataFrame, out: Outside) -> DataFrame:
    name = F.element_at("queries", 1)
    heard = F.array_contains("answered", name) if out.second else F.lit(True)
    had = F.size("found")
    asked = _failed(_asked(rows.where(~heard).withColumn("_had", had), F.array(name), out, SECOND), F.lit("reread"))
    considered = F.transform("candidates", out.domain)
    asked = asked.withColumn("_old", considered)
    more = _candidates(asked, F.filter("found", lambda r: r["pos"] >= F.col("_had")), out)
    new = F.filter("candidates", lambda c: ~F.array_contains("_old", out.domain(c)))
    more = more.withColumn("candidates", new).withColumn("n_candidates", F.col("n_candidates") + F.size("candidates"))
    return rows.where(heard).withColumn("step", F.lit("conclude")).unionByName(more.drop("_had", "_old", "n_new", "failure"))


def _reread(rows: DataFrame, out: Outside) -> DataFrame:
    return _refusal(_read(rows, out), F.lit("conclude"))


def _conclude(rows: DataFrame, out: Outside) -> DataFrame:
    heard = F.array_contains("answered", F.element_at("queries", 1)) if out.second else F.lit(False)
    none = sites.no_site_reason(F.size("queries"), F.col("n_candidates"), heard)
    there = F.col("site").isNotNull()
    return _moved(rows, F.lit("done"), F.when(there, "site").otherwise("skip"), F.when(~there, none))


_CHANGES = dict(zip(STEPS, (_ask, _silent, _narrow, _first_read, _confirm, _reread, _conclude), strict=True))


def step(states: DataFrame, name: str, out: Outside) -> DataFrame:
    """states after one superstep: those at it moved, the others as they are."""
    return states.where(F.col("step") != name).unionByName(_CHANGES[name](states.where(F.col("step") == name), out).select(states.columns))


def search(companies: DataFrame, out: Outside, root: str) -> DataFrame:
    """The states of companies (`begun`) after all supersteps. Each is written under root, a folder that driver and executors share; what is there whole is read
    and not asked for again, so a search that broke off goes on after the last superstep it finished."""
    spark, states = companies.sparkSession, None
    for k, name in enumerate(("begun", *STEPS)):
        path = f"{root}/{k}-{name}"
        if not shared.there(spark, f"{path}/_SUCCESS"):
            shared.remove(spark, path)
            (begun(companies) if states is None else step(states, name, out)).write.parquet(path)
        states = spark.read.parquet(path)
    return states
