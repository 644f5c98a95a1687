"""Rules on texts, urls and names, run over the tables' own columns, each with SQL that works them out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drafts, ids, text, urls
from ..operators import fetching, sites
from .catalogue import SQL, _query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


@_query(
    f"""with u as (select page_id, url, {_HOST} as host, {_SCHEME} as scheme from pages), a as (select *, regexp_extract(host, '([^.]+[.][^.]+)$', 1) as apex, regexp_replace(host, '^www[.]', '') as bare from u)
    select page_id, host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, apex as domain, case when bare = apex then bare end as inbox, case when host <> '' then scheme || '://' || host || '/' end as root,
        regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as plain, apex in ('example.net', 'example.com') as blocked, sha1(url) as cached,
        bare <> apex and false as other_ending, scheme in ('http', 'https') as web from a"""
)
def q_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.registered_domain(url).alias("domain"), urls.inbox_domain(url).alias("inbox"), urls.site_root(url).alias("root"), urls.without_fragment(url).alias("plain"),
        urls.is_blocked(url, ["example.net", "example.com"]).alias("blocked"), ids.cache_key(url).alias("cached"), urls.other_ending(urls.host(url), urls.registered_domain(url)).alias("other_ending"), (~F.coalesce(fetching.refused(url).startswith("refused scheme"), F.lit(False))).alias("web"),
    )


@_query(
    f"""with u as (select page_id, url, {_HOST} as host, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as root, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as href from pages),
    j as (select page_id, host, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when href like '//%' then regexp_extract(url, '^([^:]*:)', 1) || href when href like '/%' then root || href else '?' end as link from u),
    k as (select distinct page_id, regexp_replace(regexp_replace(link, '#.*$', ''), '/+$', '') as link from j where lower(regexp_extract(link, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)) = host)
    select p.page_id, coalesce(count(k.link), 0) as n, coalesce(string_agg(k.link, ' ' order by k.link), '') as links from pages p left join k on k.page_id = p.page_id group by p.page_id"""
)
def q_harvested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all pages that stay on their hosts."""
    hrefs = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    links = sites.harvested_links(F.transform(hrefs, lambda h: fetching.joined(F.col("url"), h)), F.col("url"))
    rows = _table(spark, sf_dir, "pages").withColumn("links", F.coalesce(F.sort_array(links), F.array().cast("array<string>")))
    return rows.select("page_id", F.size("links").cast("long").alias("n"), F.array_join("links", " ").alias("links"))


@_query(
    """with m as (select conv_id, turn, 'mailto:' || 'k' || conv_id || '@x.example' || '?subject=' || url_encode(role || ' für Zürich & Co') || '&body=' || url_encode(regexp_replace(text, '\\r?\\n', chr(13) || chr(10), 'g')) as link,
        'https://o.example/c?a=1&to=' || url_encode('k' || conv_id || '@x.example') || '&subject=' || url_encode(role) || '&body=' || url_encode(text) as web, text from conversations where text is not null)
    select conv_id, turn, link, length(link) < 2000 as fits, web, length(web) < 2000 as web_fits, sha256(text) as body from m"""
)
def q_mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that write each turn of a conversation as a mail."""
    to = F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit("@x.example"))
    rows = _table(spark, sf_dir, "conversations").where("text is not null")
    rows = rows.withColumns({"m": ids.mailto(to, F.concat("role", F.lit(" für Zürich & Co")), F.col("text")), "o": ids.outlook("https://o.example/c?a=1", to, F.col("role"), F.col("text"))})
    return rows.select("conv_id", "turn", "m.link", "m.fits", F.col("o.link").alias("web"), F.col("o.fits").alias("web_fits"), ids.body_sha256(F.col("text")).alias("body"))


@_query(
    """select doc_id, case when length(text) <= 80 then text else regexp_replace(substring(text, 1, 80), '\\s+\\S*$', '') end as cut, contains(text, trim(substring(text, 1, 20))) and contains(text, trim(substring(text, 40, 20))) and (trim(substring(text, 1, 20)) || trim(substring(text, 40, 20))) <> '' as quoted,
        trim(source) <> '' and contains(text, source) as named, lower(trim(substring(text, 1, 12))) = lower(trim(substring(text, 1, 12))) and contains(lower(text), trim(lower(substring(text, 5, 12)))) and trim(substring(text, 5, 12)) <> '' as there
    from documents where text is not null and not contains(substring(text, 1, 60), '..') and not contains(substring(text, 1, 60), '…')"""
)
def q_quoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut between words, and quotations of two parts found in them."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").where(~F.substring("text", 1, 60).contains("..") & ~F.substring("text", 1, 60).contains("…"))
    quote = F.concat(F.substring("text", 1, 20), F.lit("…"), F.substring("text", 40, 20))
    there = text.appears_in(F.lower(F.substring("text", 5, 12)), F.lower("text"))
    return rows.select("doc_id", text.truncated(F.col("text"), 80).alias("cut"), text.quote_found(quote, F.col("text")).alias("quoted"), text.appears_in(F.col("source"), F.col("text")).alias("named"), there.alias("there"))


@_query(
    "select event_id, day(ts) || '. ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(ts)] || ' ' || year(ts) as day, strftime(ts, '%Y-%m') as month from events"
)
def q_german_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", text.german_date(F.to_date("ts")).alias("day"), F.date_format("ts", "yyyy-MM").alias("month"))


_FOLDED = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(word), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'é', 'e'), 'è', 'e'), 'à', 'a'), 'ç', 'c'), '[^a-z0-9]+', ' ', 'g'))"


@_query(
    f"""with w as (select doc_id, substring(text, 1, 30) as word from documents where text is not null), f as (select doc_id, {_FOLDED} as words from w)
    select doc_id, words, case when words = '' then '' when contains(words, ' ') then replace(words, ' ', '') || '.ch,' || replace(words, ' ', '') || '.com,' || replace(words, ' ', '-') || '.ch,' || replace(words, ' ', '-') || '.com' else words || '.ch,' || words || '.com' end as domains from f"""
)
def q_name_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains guessed from the first words of texts, as if these were firms' names: letters with marks, signs and blanks among them."""
    word = F.substring("text", 1, 30)
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.folded_domain_name(word).alias("words"), F.array_join(ids.guessed_domains(word), ",").alias("domains"))


#: Rules of drafted sentences in another dialect of patterns: Spark's knows letters of all scripts as word characters, DuckDB's only where it is told.
_W, _NOT_W = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"


def _whole(pattern: str) -> str:
    """Words between word borders."""
    inner = re.search(r"\\b\((.*)\)(?:\\b|\(\?=)", pattern)[1]
    return f"(?i)(^|{_NOT_W})({inner.replace(chr(92) + 'w', _W)})({_NOT_W}|$)"


_EMAIL = rf"(?:{_W}|[.+-])+@(?:{_W}|-)+(?:\.(?:{_W}|-)+)+"
_RULES = {
    "line_break": "contains(said, chr(10))", "second_sentence": rf"regexp_matches(said, '[!?]|{_W}{{4,}}\.[\s\p{{Z}}]+[A-ZÄÖÜ]')",
    "too_long": f"len(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w <> '')) > {drafts.WORDS} or length(said) > {drafts.CHARS}",
    "role_noun": "len(list_filter(low, lambda w: ({}) and not ({}))) > 0".format(" or ".join(f"ends_with(w, '{r.lower() + e}')" for r in drafts.ROLES for e in ("", "in", "innen")), " or ".join(f"ends_with(w, '{r}')" for r in drafts.NOT_ROLES)),
    "frame_word": f"regexp_matches(said, '{_whole(drafts.PATTERNS['frame_word'])}')", "banned_word": f"regexp_matches(said, '{_whole(drafts.PATTERNS['banned_word'])}')",
    "legal_form": rf"regexp_matches(said, '(^|{_NOT_W})(AG|GmbH|SA|Sàrl|KG|Co\.)({_NOT_W}|$)')", "year": rf"regexp_matches(said, '(^|{_NOT_W})(18|19|20)\d{{2}}({_NOT_W}|$)')",
    "placeholder": rf"regexp_matches(said, '[\[\]{{}}<>®™©]|\.\.\.|…|(^|{_NOT_W})X[XY]({_NOT_W}|$)')",
    "english": "len(list_distinct(list_filter(low, lambda w: w in ({})))) >= 2".format(", ".join(f"'{w}'" for w in drafts.ENGLISH)), "email": f"regexp_matches(said, '{_EMAIL}')",
    "link": rf"regexp_matches(bare, '(?i)https?://\S|www\.\S') or regexp_matches(bare, '(^|[^\p{{L}}\p{{N}}_-])[A-Za-z0-9-]+\.(?:[a-z]{{2,24}}|(?i:{'|'.join(drafts.ENDINGS)}))(?:-[A-Za-z0-9-]*)?([^\p{{L}}\p{{N}}_-]|$)')"
    rf" or regexp_matches(bare, '(?i)(^|{_NOT_W})h[tx][tx]ps?({_NOT_W}|$)|[\[({{]\s*(?:{'|'.join(drafts.SIGNS)})\s*[\])}}]|\s(?:{'|'.join(drafts.DOTS)})\s+(?:{'|'.join(drafts.SPOKEN_ENDINGS)})({_NOT_W}|$)')",
}
SQL["q_sentence_problems"] = (
    f"with s as (select doc_id, '{drafts.PREFIX}' || text || '.' as said from documents), t as (select *, list_transform(regexp_split_to_array(said, '{_NOT_W}+'), lambda w: lower(w)) as low, regexp_replace(said, '{_EMAIL}', ' ', 'g') as bare from s) "
    "select doc_id, case when said is not null then array_to_string(list_filter([" + ", ".join(f"case when {_RULES[k]} then '{k}' end" for k in drafts.ORDER if k in _RULES) + "], lambda r: r is not null), ',') end as problems from t"
)
SQL["q_normalise"] = r"select doc_id, trim(regexp_replace(lower(replace(nfc_normalize(text), 'ß', 'ss')), '[\s\x{0085}\p{Z}]+', ' ', 'g')) as normalised from documents"
