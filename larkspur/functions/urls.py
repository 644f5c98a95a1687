"""Hosts, domains and kinds of pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of more than one label under which anybody may register, and hosts of site builders.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.at", "or.at", "github.io", "blogspot.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "herokuapp.com")
BUILDERS = (
    "jimdosite.com", "jimdofree.com", "jimdo.com", "webnode.ch", "webnode.com", "webnode.de", "webnode.fr", "webnode.it", "webnode.page",
    "business.site", "wordpress.com", "weebly.com", "squarespace.com", "site123.me", "godaddysites.com", "mystrikingly.com",
)
#: Words that tell a page's kind.
IMPRESSUM = r"impressum|imprint|mentions.legales|note.legali|legal.notice"
CONTACT = r"kontakt|contact|contatti"
ABOUT = r"ueber.uns|über.uns|about|a.propos|chi.siamo|wir.sind|team"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def apex(name: Column, suffixes: tuple[str, ...] = SUFFIXES + BUILDERS) -> Column:
    """The part of a host that was registered: one label more than its suffix. A host of one label stays as it is."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"\.+$", "")
    long = "|".join(s.replace(".", r"\.") for s in suffixes)
    under = F.regexp_extract(bare, rf"([^.]+\.(?:{long}))$", 1)
    return F.when(bare.rlike(r"^[0-9.]+$"), bare).when(under != "", under).otherwise(F.coalesce(F.nullif(F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1), F.lit("")), F.regexp_replace(bare, r"^www\.", "")))


def registered_domain(url: Column) -> Column:
    return F.when(host(url) != "", apex(host(url)))


def inbox_domain(url: Column) -> Column:
    """The domain where info@ may be guessed: the site's host, if that is a domain of its own."""
    bare, builders = F.regexp_replace(host(url), r"^www\.", ""), "|".join(s.replace(".", r"\.") for s in SUFFIXES + BUILDERS)
    return F.when((bare != "") & (bare == apex(bare)) & ~bare.rlike(rf"\.(?:{builders})$"), bare)


def site_root(url: Column) -> Column:
    return F.when(host(url) != "", F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host(url), F.lit("/")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def page_kind(url: Column) -> Column:
    """0 for an imprint, 1 for contact, 2 for about: the first whose words stand whole in the path; else null."""
    words = F.lower(F.coalesce(F.try_url_decode(path(url)), path(url)))
    whole = lambda x: words.rlike(rf"(^|[^a-z0-9äöü])(?:{x})($|[^a-z0-9äöü])")
    return F.when(whole(IMPRESSUM), 0).when(whole(CONTACT), 1).when(whole(ABOUT), 2)


def is_blocked(url: Column, blocked: list[str]) -> Column:
    """Whether a url's registered domain is on a short list, or under an entry of it. For long lists join on registered_domain."""
    domain = registered_domain(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, blocked)).cast("array<string>"), lambda b: (domain == b) | domain.endswith(F.concat(F.lit("."), b))), F.lit(False))


def sitemap_locations(xml: Column) -> Column:
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))


def is_sitemap_index(xml: Column) -> Column:
    return F.lower(xml).contains("<sitemapindex")


def other_ending(name: Column, site: Column) -> Column:
    """Whether two hosts of two labels each differ in nothing but the last."""
    two = r"^([^.]+)\.([^.]+)$"
    part = lambda x, k: F.regexp_extract(x, two, k)
    return F.coalesce((part(name, 1) != "") & (part(name, 1) == part(site, 1)) & (part(name, 2) != part(site, 2)), F.lit(False))
