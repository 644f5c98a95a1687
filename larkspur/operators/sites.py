"""Finding a company's site and whom to write to: searches asked, candidates, refusals, leads, and pages in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text, urls

#: Local parts of inboxes, and where legal and contact pages stand on sites that don't link them.
GENERIC = (
    "info", "kontakt", "contact", "office", "mail", "post", "hello", "hallo", "welcome", "admin", "sekretariat", "empfang", "verkauf", "sales",
    "service", "team", "buero", "bureau", "zentrale", "anfrage", "inquiry",
)
FALLBACKS = ("/impressum", "/kontakt", "/contact", "/about", "/ueber-uns")


def search_queries(name: Column, place: Column, uid: Column) -> Column:
    """The three queries of a company, in order: its quoted name with its place, its name on an imprint, its number in both spellings."""
    short = text.without_legal_form(name)
    return F.array(F.concat(F.lit('"'), short, F.lit('" '), place), F.concat(short, F.lit(" Impressum")), F.concat(F.lit('"'), ids.dotted_uid(uid), F.lit('" OR "'), uid, F.lit('"')))


def narrowing_query(name: Column, place: Column) -> Column:
    return F.concat(F.lit('site:.ch "'), text.without_legal_form(name), F.lit('" '), place)


def answered_by(asked: DataFrame, provider: str) -> DataFrame:
    """uid and query of what a provider answered, with results or with none; an error is no answer."""
    return asked.where((F.col("provider") == provider) & F.col("error").isNull()).select("uid", "query").distinct()


def candidates(results: DataFrame, most: int) -> DataFrame:
    """uid, url and rank: the first result of each registered domain, and of those the first most for each company (the feature: so many sites are read)."""
    first = results.withColumn("domain", urls.registered_domain(F.col("url"))).where("domain is not null").groupBy("uid", "domain").agg(F.min(F.struct("pos", "url")).alias("r"))
    listed = first.groupBy("uid").agg(F.slice(F.sort_array(F.collect_list("r")), 1, most).alias("r"))
    return listed.select("uid", F.posexplode("r").alias("rank", "x")).select("uid", F.col("x.url").alias("url"), (F.col("rank") + 1).alias("rank"))


def untried(candidates: DataFrame, tried: DataFrame) -> DataFrame:
    """Candidates whose registered domain none of a company's tried urls has."""
    with_domain = lambda df: df.withColumn("domain", urls.registered_domain(F.col("url")))
    return with_domain(candidates).join(with_domain(tried).select("uid", "domain").distinct(), ["uid", "domain"], "left_anti").select(candidates.columns)


def storable(candidates: DataFrame, results: DataFrame, paid: str) -> DataFrame:
    """Candidates that some provider but the paid one found; the paid one's licence forbids to store what it alone found."""
    free = results.where(F.col("provider") != paid).select("uid", "url").distinct()
    return candidates.join(free, ["uid", "url"], "left_semi")


def refusals(read: DataFrame) -> DataFrame:
    """uid, outcome and reasons of reading candidates (uid, url, refused: reason or null, lasting): read if one let us, else refused for good or for now."""
    rows = read.groupBy("uid").agg(F.bool_and(F.col("refused").isNotNull()).alias("every"), F.bool_and(F.coalesce("lasting", F.lit(False))).alias("lasting"), F.array_join(F.sort_array(F.collect_list("refused")), ", ").alias("reasons"))
    return rows.select("uid", F.when(~F.col("every"), "read").when(F.col("lasting"), "every candidate refused").otherwise("no candidate could be read").alias("outcome"), F.when(F.col("every"), F.col("reasons")).alias("reasons"))


def after_refusal(outcome: Column, previous_error: Column) -> Column:
    """error the first time that every candidate refuses, and where it may pass; skip once the same lasting refusal came before."""
    lasting = outcome == "every candidate refused"
    return F.when(outcome == "read", F.lit(None).cast("string")).when(lasting & F.coalesce(previous_error.startswith("every candidate refused"), F.lit(False)), "skip").otherwise("error")


def no_site_reason(searches: Column, candidates: Column, second_provider: Column) -> Column:
    looked = F.when(candidates > 0, F.concat(F.lit(", "), candidates.cast("string"), F.lit(" candidate(s) checked"))).otherwise("")
    return F.concat(F.lit("no website found after "), searches.cast("string"), F.lit(" searches and a domain guess"), looked, F.when(second_provider, "; Brave was also asked").otherwise(""))


def moved_to(url: Column, final: Column) -> Column:
    """The root of where a candidate's page ended, if that is another domain; else the candidate as it is."""
    other = urls.registered_domain(final).isNotNull() & (urls.registered_domain(final) != urls.registered_domain(url))
    return F.when(F.coalesce(other, F.lit(False)), urls.site_root(final)).otherwise(url)


def on_site(email: Column, site: Column) -> Column:
    """Whether an address belongs to a site: its registered domain, or the site's very name under another ending."""
    host = F.regexp_replace(ids.email_host(email), r"^www\.", "")
    return (urls.apex(ids.email_host(email)) == site) | urls.other_ending(host, site)


def inbox(addresses: Column, site: Column) -> Column:
    """The first of a page's addresses (array) that is an inbox of the site; null without one."""
    return F.get(F.filter(addresses, lambda a: F.coalesce(on_site(a, site), F.lit(False)) & F.regexp_extract(a, "^([^@]*)", 1).isin(*GENERIC)), F.lit(0))


def described(name: Column, role: Column, email: Column) -> Column:
    return F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (name, role, email)))


def first_pages(addresses: DataFrame) -> DataFrame:
    """email and the page that carried it first. addresses: pos (of the page), url and emails (array)."""
    seen = addresses.select("pos", "url", F.explode("emails").alias("email"))
    return seen.groupBy("email").agg(F.min_by("url", F.struct("pos", "url")).alias("url"))


def is_lead(url: Column, title: Column, company: Column, name: Column) -> Column:
    """Whether a search result is a person's profile: its host and path, the company's longest word in its title, and the surname, if a name is known. Texts are in lower case."""
    words = lambda x: F.split(F.trim(x), r"\s+")
    longest = F.get(F.sort_array(F.transform(words(company), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), F.lit(0))["w"]
    host = urls.host(url)
    profile = ((host == "linkedin.com") | host.endswith(".linkedin.com")) & urls.path(url).startswith("/in/")
    return profile & title.contains(longest) & (name.isNull() | title.contains(F.element_at(words(name), -1)))


def leads(results: DataFrame) -> DataFrame:
    """uid and url of each company's first result (uid, pos, url, title, company, name) that is a lead."""
    fits = results.where(is_lead(F.col("url"), F.col("title"), F.col("company"), F.col("name")))
    return fits.groupBy("uid").agg(F.min_by("url", "pos").alias("url"))


def harvested_links(links: Column, base: Column) -> Column:
    """Absolute links of a page that stay on its host, without fragments, once, in order."""
    same = F.filter(links, lambda x: (urls.host(x) != "") & (urls.host(x) == urls.host(base)))
    return F.array_distinct(F.transform(same, urls.without_fragment))


def fallback_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """url of the first fall-back path of each site (uid, root) that has text among pages (url, text)."""
    wanted = sites.select("uid", F.posexplode(F.transform(F.array(*map(F.lit, FALLBACKS)), lambda p: F.concat(F.regexp_replace("root", "/+$", ""), p))).alias("rank", "url"))
    there = wanted.join(pages.where("trim(text) <> ''").select("url"), "url", "left_semi")
    return there.groupBy("uid").agg(F.min_by("url", "rank").alias("url"))


def prompt_text(parts: dict[str, Column], most: int) -> Column:
    """Parts that there are under their labels, each cut to most characters between words."""
    return F.concat_ws("\n\n", *(F.when(F.trim(x) != "", F.concat(F.lit(f"## {label}\n"), text.truncated(x, most))) for label, x in parts.items()))
