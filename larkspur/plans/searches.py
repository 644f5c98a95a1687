"""Queries over the search for sites, walks of sitemaps and names in files, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import density, text, urls
from ..operators import contact_choice, fetching, names, site_search, walks
from ..sources import shared
from . import answers
from .catalogue import _query

_BLOCKED = ("casino-win.example.com", "spam-farm.example.com", "free-bets.example.com", "cheap-pills.example.com")
_MOST = 3
#: What recorded searches said: the newest order of a customer for each query (0 to 2, 3 the narrower one) and provider; page numbers of what it found.
_TOLD = """select uid, slot, provider, error, case when error is null then p1 end as p1, case when error is null then p2 end as p2 from (
    select o_custkey as uid, cast(o_orderkey % 4 as int) as slot, case when o_orderstatus = 'O' then 'second' else 'first' end as provider, case when o_orderpriority = '1-URGENT' then 'timeout' end as error,
    case when o_totalprice > 200000 then o_orderkey % n end as p1, case when o_totalprice > 350000 then o_custkey % n end as p2, row_number() over (partition by o_custkey, o_orderkey % 4, o_orderstatus = 'O' order by o_orderkey desc) as k
    from orders cross join (select count(*) as n from pages) c) t where k = 1"""
#: What reading pages says, by url.
_READ = """select url, case length(html) % 4 when 1 then 'captcha' when 2 then 'timeout' end as refused, length(html) % 4 = 1 as lasting, case when length(html) % 7 = 0 then ' ' else html end as text,
    case when length(html) % 9 = 0 then 'https://moved.example.net/x' else url end as final from (select url, html, row_number() over (partition by url order by page_id) as k from pages) p where k = 1"""
_COMPANIES = """select c_custkey as uid, case when c_nationkey % 3 = 0 then 'every candidate refused (captcha)' end as previous_error, case when c_custkey % 11 = 0 then c_custkey % n end as guess
    from customer cross join (select count(*) as n from pages) c"""


def _domain(url: Column) -> Column:
    return F.when(urls.host(url) != "", urls.apex(urls.host(url), suffixes=("example.com", "example.net", "example.org")))


def _asks(told: DataFrame, pages: DataFrame, root: str):
    """The provider: what is recorded of each query, and no result where nothing is. It is stored under root."""
    known = _with_url(_with_url(told, "p1", pages, "u1"), "p2", pages, "u2")
    known = known.select("uid", F.concat(F.lit("q"), F.col("slot").cast("string")).alias("query"), "provider", "error", F.array_compact(F.array("u1", "u2")).alias("urls"))

    known = _stored(known, f"{root}/told")

    def ask(wanted: DataFrame) -> DataFrame:
        return shared.met(wanted, known, ["uid", "query", "provider"], "left")

    return ask


def _with_url(rows: DataFrame, page: str, pages: DataFrame, name: str) -> DataFrame:
    """rows (uid, page) with the page's url. Rows without a page are dealt out by uid, as one task would get them all."""
    key = F.coalesce(F.col(page), -1 - F.col("uid"))
    urls_ = pages.select(F.col("page_id").alias("_page"), F.col("url").alias("_url"))
    return shared.met(rows.withColumn("_page", key), urls_, "_page", "left").withColumn(name, F.when(F.col(page).isNotNull(), F.col("_url"))).drop("_page", "_url")


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """rows, written to a folder and read back, so that supersteps don't derive them anew."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def outside(spark: SparkSession, sf_dir: str, second: bool) -> tuple[DataFrame, site_search.Outside]:
    """Companies and what is outside of a search over a folder's tables: recorded answers, pages as they refuse or let read, and a chooser by the length of texts.

    Answers and pages are stored once for all supersteps."""
    root = shared.shared_folder(spark, "outside")
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "pages", "customer")}
    made = lambda text: spark.sql(text.replace("from orders", "from {orders}").replace("from pages", "from {pages}").replace("from customer", "from {customer}"), **{k: v for k, v in t.items() if f"from {k}" in text})
    pages = _stored(made(_READ), f"{root}/pages")
    known = _with_url(made(_COMPANIES), "guess", t["pages"], "url")
    companies = known.select("uid", F.array(*(F.lit(f"q{k}") for k in range(3))).alias("queries"), F.lit("q3").alias("narrowing"), "previous_error", F.array_compact(F.array("url")).alias("guesses"))
    read = lambda wanted: shared.met(wanted, pages, "url")
    choose = lambda texts: texts.where("length(text) % 3 = 0").groupBy("uid").agg(F.min("url").alias("url"))
    return companies, site_search.Outside(_asks(made(_TOLD), t["pages"], root), read, choose, second, _BLOCKED, _MOST, _domain)


_DOMAIN_OF = r"regexp_extract(lower(regexp_extract({0}, '://([^/?#:]*)', 1)), '([^.]+\.example\.(com|net|org))$', 1)"
_PICK = """select uid, pos, url, domain from (select uid, domain, min(pos) as pos, arg_min(url, (case when regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') = domain then 0 else 1000000 end) + pos) as url
    from (select *, {domain} as domain from {found}) f where domain not in ({blocked}) group by uid, domain) g qualify row_number() over (partition by uid order by pos) <= {most}"""
_READING = """select c.uid, bool_and(r.refused is not null) as every_, bool_and(r.lasting) as lasting, string_agg(r.refused, ', ' order by r.refused) as reasons,
    min(case when r.refused is null and trim(r.text) <> '' and length(r.text) % 3 = 0 then case when {final} <> c.domain then 'https://moved.example.net/' else c.url end end) as site from {cands} c join read_ r on r.url = c.url group by c.uid"""


def _pick(found: str) -> str:
    return _PICK.format(domain=_DOMAIN_OF.format("url"), found=found, blocked=", ".join(f"'{b}'" for b in _BLOCKED), most=_MOST)


_VERDICT = f"""with told as ({_TOLD}), read_ as ({_READ}), companies as ({_COMPANIES}),
    asked as (select c.uid, q.slot, case when f.error is null then 'first' else 'second' end as provider, case when f.error is not null then s.error end as error, case when f.error is null then f.p1 else s.p1 end as p1, case when f.error is null then f.p2 else s.p2 end as p2,
        s.error as s_error, s.p1 as s1, s.p2 as s2 from companies c cross join (select unnest([0, 1, 2, 3]) as slot) q left join told f on f.uid = c.uid and f.slot = q.slot and f.provider = 'first' left join told s on s.uid = c.uid and s.slot = q.slot and s.provider = 'second'),
    a as (select uid, min(case when error is not null then 'q' || slot || ': ' || error end) as failure, count(p1) + count(p2) as n from asked where slot < 3 group by uid),
    s as (select x.uid, min(case when s_error is not null then 'q' || slot || ': ' || s_error end) as failure from asked x join a using (uid) where a.failure is null and a.n = 0 and slot < 2 and provider = 'first' group by x.uid),
    f0 as (select uid, slot * 10 as pos, p1 as p from asked where slot < 3 union all select uid, slot * 10 + 1, p2 from asked where slot < 3
        union all select x.uid, 100 + slot * 10, s1 from asked x join a using (uid) where a.n = 0 and slot < 2 and provider = 'first' union all select x.uid, 100 + slot * 10 + 1, s2 from asked x join a using (uid) where a.n = 0 and slot < 2 and provider = 'first'),
    f1 as (select f0.uid, pos, url from f0 join pages on page_id = p),
    heard as (select uid, slot from asked where slot < 3 and provider = 'second' and error is null union select x.uid, slot from asked x join a using (uid) where a.n = 0 and slot < 2 and provider = 'first' and s_error is null),
    bare as (select c.uid from companies c where not exists (select 1 from ({_pick("f1")}) k where k.uid = c.uid)),
    w as (select x.uid, 'q3: ' || x.error as failure from asked x join bare using (uid) where slot = 3),
    ended as (select c.uid, coalesce(a.failure, s.failure, w.failure) as failure from companies c join a using (uid) left join s using (uid) left join w using (uid)),
    f2 as (select * from f1 union all select x.uid, 200, url from asked x join bare using (uid) join pages on page_id = p1 where slot = 3 union all select x.uid, 201, url from asked x join bare using (uid) join pages on page_id = p2 where slot = 3
        union all select c.uid, -1, url from companies c join pages on page_id = guess),
    c1 as ({_pick("(select f2.* from f2 join ended using (uid) where failure is null) y")}),
    r1 as ({_READING.format(final=_DOMAIN_OF.format("r.final"), cands="c1")}),
    open_ as (select e.uid from ended e left join r1 on r1.uid = e.uid where e.failure is null and coalesce(not every_, true) and r1.site is null and e.uid not in (select uid from heard where slot = 0)),
    t as (select x.uid, 'q0: ' || s_error as failure from asked x join open_ using (uid) where slot = 0),
    f3 as (select x.uid, 0 as pos, url from asked x join open_ using (uid) join pages on page_id = s1 where slot = 0 union all select x.uid, 1, url from asked x join open_ using (uid) join pages on page_id = s2 where slot = 0),
    c2 as (select k.* from ({_pick("f3")}) k where not exists (select 1 from c1 where c1.uid = k.uid and c1.domain = k.domain)),
    r2 as ({_READING.format(final=_DOMAIN_OF.format("r.final"), cands="c2")}),
    n as (select uid, count(*) as n from (select uid, url from c1 union all select uid, url from c2) x group by uid),
    v as (select c.uid, c.previous_error, e.failure as f1, r1.every_ as e1, r1.lasting as l1, r1.reasons as why1, r1.site as s1, t.failure as f2, r2.every_ as e2, r2.lasting as l2, r2.reasons as why2, r2.site as s2, coalesce(n.n, 0) as n,
        c.uid in (select uid from heard where slot = 0) or (c.uid in (select uid from open_) and t.failure is null) as heard from companies c join ended e using (uid) left join r1 using (uid) left join t using (uid) left join r2 using (uid) left join n using (uid)),
    x as (select *, coalesce(f1, f2) as failure, coalesce(e1 or e2, false) as every_, case when e1 then l1 else l2 end as lasting, case when e1 then why1 else why2 end as why, coalesce(s1, s2) as site from v)
    select uid, case when failure is null and not every_ then site end as site,
        case when failure is not null then 'error' when every_ then case when lasting and previous_error is not null then 'skip' else 'error' end when site is not null then 'site' else 'skip' end as verdict,
        case when failure is not null then 'search failed: ' || failure when every_ then case when lasting then 'every candidate refused' else 'no candidate site could be read' end || ' (' || why || ')'
            when site is null then 'no website found after 3 searches and a domain guess' || case when n > 0 then ', ' || n || ' candidate(s) checked' else '' end || case when heard then '; Brave was also asked' else '' end end as reason from x"""


@_query(_VERDICT)
def q_search_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every customer as a company whose searches are recorded, with a second provider."""
    companies, out = outside(spark, sf_dir, second=True)
    return site_search.search(companies, out, shared.shared_folder(spark, "site_search")).select("uid", "site", "verdict", "reason")


#: A customer's orders stand for the sitemaps of a site: the r-th has 2r and 2r + 1 nested, and the first again; every third lists the order's lines as pages instead.
_MAPS = """select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders"""
_LIMIT = 1


@_query(
    f"""with recursive maps as ({_MAPS}),
    walk(site, r) as (select o_custkey, r from maps where r = 1 union select m.o_custkey, m.r from walk w join maps m on m.o_custkey = w.site and m.r in (2 * w.r, 2 * w.r + 1, 1) where w.r % 3 <> 0),
    met as (select w.site, w.r, m.o_orderkey, count(l_orderkey) as n from walk w join maps m on m.o_custkey = w.site and m.r = w.r left join lineitem on l_orderkey = m.o_orderkey and w.r % 3 = 0 group by all),
    read_ as (select *, coalesce(sum(n) over (partition by site order by r rows between unbounded preceding and 1 preceding), 0) < {10 * _LIMIT} as ok from met),
    pages_ as (select site, r, l_linenumber as c, l_partkey as d, 'part' || l_partkey as url from read_ join lineitem on l_orderkey = o_orderkey where ok and r % 3 = 0),
    every_ as (select * from pages_ union all select c_custkey, -1, k, 0, 'home' || c_nationkey || '/' || k from customer cross join (select unnest([0, 1]) as k) x where c_custkey not in (select site from pages_)
        union all select c_custkey, 1000000, 0, 0, cast(c_custkey as varchar) from customer)
    select site, row_number() over (partition by site order by r, c, d) as n, url from every_"""
)
def q_sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all customers as sites, by a walk through their sitemaps."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "customer")}
    orders = spark.sql(_MAPS.replace("from orders", "from {orders}"), orders=t["orders"])
    lines = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("part"), x["l_partkey"].cast("string"))).alias("pages"))
    named = lambda r: F.concat("o_custkey", F.lit("/"), r)
    leaf = F.col("r") % 3 == 0
    none = F.array().cast("array<string>")
    maps = orders.join(lines, "o_orderkey", "left").select(named(F.col("r")).alias("url"), F.when(leaf, F.coalesce("pages", none)).otherwise(none).alias("pages"), F.when(leaf, none).otherwise(F.array(named(2 * F.col("r")), named(2 * F.col("r") + 1), named(F.lit(1)))).alias("nested"))
    sites = t["customer"].select(F.col("c_custkey").alias("site"), F.concat("c_custkey", F.lit("/1")).alias("start"))
    homes = t["customer"].select(F.col("c_custkey").alias("site"), F.transform(F.array(F.lit("0"), F.lit("1")), lambda k: F.concat(F.lit("home"), F.col("c_nationkey").cast("string"), F.lit("/"), k)).alias("links"))
    return walks.sitemap_pages(sites, maps, homes, _LIMIT, shared.shared_folder(spark, "sitemaps"))


_NAMED = """with names as (select distinct lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as name from pages)"""


@_query(_NAMED + " select page_id, name from pages join names on contains(lower(html), name) where name <> ''")
def q_hosts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages name which of all hosts, in one pass of an automaton."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return names.named_in(pages, pages.select(urls.host(F.col("url")).alias("name")), "page_id", "html")


_WORDS_OF = "case when {0} = '' then 0 else len(string_split({0}, ' ')) end"


def _plain_sql(x: str) -> str:
    x = f"regexp_replace({x}, '{density.TAG_PATTERN}', '', 'g')"
    for name, char in density.ENTITIES:
        x = f"replace({x}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@_query(
    f"""with parts as (select page_id, generate_subscripts(p, 1) as i, unnest(p) as part from (select page_id, regexp_split_to_array(regexp_replace(html, '{density.UNSEEN_PATTERN}', ' ', 'g'), '{density.BLOCK_PATTERN}') as p from pages where html is not null) x),
    said as (select page_id, i, {_plain_sql("part")} as text, trim(array_to_string(list_transform(regexp_extract_all(part, '{density.LINK_PATTERN}', 1), lambda x: {_plain_sql("x")}), ' ')) as linked from parts),
    counted as (select page_id, i, text, {_WORDS_OF.format("text")} as n, {_WORDS_OF.format("linked")} as links from said where text <> ''),
    beside as (select *, links / n as d, coalesce(lag(links / n) over w, 0) as bd, coalesce(lag(n) over w, 0) as bn, coalesce(lead(n) over w, 0) as an from counted window w as (partition by page_id order by i)),
    judged as (select *, case when d > {density.LINKS} then false when bd <= {density.LINKS_BEFORE} then n > {density.FEW} or an > {density.FEW_AFTER} or bn > {density.FEW_BEFORE} else n > {density.LONG} or an > {density.FEW_AFTER_LINKS} end as main from beside),
    totals as (select page_id, coalesce(sum(n) filter (where main), 0) as m, sum(n) as every_ from judged group by page_id)
    select p.page_id, case when p.html is not null then coalesce(string_agg(j.text, chr(10) order by j.i), '') end as main_text from pages p left join totals t on t.page_id = p.page_id left join judged j on j.page_id = p.page_id and (j.main or (t.m < {density.THIN} and t.every_ > t.m)) group by p.page_id, p.html"""
)
def q_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages by the density of text and links."""
    return density.with_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).drop("html")


#: Suppliers as companies, with customers as the people of their sites, documents as pages, and orders as the register's notices.
_SITES = """select s_suppkey as uid, case when s_suppkey % 4 = 0 then concat('https://de.mail', s_suppkey % 10, '.example.com/') else concat('https://www.mail', s_suppkey % 10, '.example.com/') end as site from supplier"""
_PEOPLE = """select c_custkey % n as uid, c_custkey as pos, case when c_custkey % 5 = 0 then 'Anna' else concat('Anna K', c_custkey) end as name,
    case c_mktsegment when 'BUILDING' then 'Inhaberin' when 'MACHINERY' then 'Präsident' when 'AUTOMOBILE' then 'Monteur' when 'FURNITURE' then 'CEO' end as role,
    case when c_acctbal > 7000 then concat('k', c_custkey, '@mail', c_custkey % n % 10, '.example.com') when c_acctbal < 3000 then concat('k', c_custkey, '@else.example.org') end as email
    from customer cross join (select count(*) as n from supplier) x where c_nationkey < 2"""
_PAGES = """select doc_id % n as uid, doc_id as pos, concat('https://page', doc_id) as url, concat(text, case when length(text) % 3 = 0 then concat(' info@mail', doc_id % n % 10, '.example.com') when length(text) % 7 = 0 then concat(' Anna K', doc_id % n) else '' end) as text
    from documents cross join (select count(*) as n from supplier) x where text is not null"""
_NOTICES = """select o_custkey % n as uid, o_orderkey as pos, concat('Reg K', o_custkey) as name, case o_orderpriority when '1-URGENT' then 'Geschäftsführer' when '2-HIGH' then 'Präsident' when '3-MEDIUM' then 'Mitglied' end as role,
    cast(o_orderdate as date) as published, o_orderstatus = 'F' as departed, concat('https://notice', o_orderkey) as url from orders cross join (select count(*) as n from supplier) x where o_custkey % 3 = 0"""
_LEADS = "select s_suppkey as uid, concat('https://ch.linkedin.com/in/s', s_suppkey) as url from supplier where s_nationkey % 2 = 0"
_ADDRESS_SQL = "'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'"


def _apex_sql(host: str) -> str:
    return rf"case when regexp_matches({host}, '[^.]+\.example\.(com|net|org)$') then regexp_extract({host}, '([^.]+\.example\.(com|net|org))$', 1) else regexp_extract({host}, '([^.]+\.[^.]+)$', 1) end"


def _rank_sql(role: str) -> str:
    return f"case when {role} is null then 3 when regexp_matches(lower({role}), '{text.HEADS}') then 0 when regexp_matches(lower({role}), '{text.CHAIRS}') then 1 else 2 end"


_CONTACTS = f"""with sites as (select *, 'mail' || (uid % 10) || '.example.com' as domain, case when uid % 4 <> 0 then 'mail' || (uid % 10) || '.example.com' end as guess from ({_SITES}) s), people as ({_PEOPLE}), docs as ({_PAGES}), notices as ({_NOTICES}), leads as ({_LEADS}),
    found as (select uid, pos, url, generate_subscripts(e, 1) as place, unnest(e) as email from (select *, list_transform(regexp_extract_all(text, {_ADDRESS_SQL}), lambda x: lower(x)) as e from docs) x),
    first_ as (select uid, email, arg_min(url, pos * 100000 + place) as url, min(pos * 100000 + place) as slot from found group by uid, email),
    kinds as (select f.*, case when {_apex_sql("split_part(email, '@', 2)")} <> domain then 'third_party' when split_part(email, '@', 1) in ({", ".join(f"'{g}'" for g in ("info", "kontakt", "contact", "office", "mail", "post", "hello", "hallo", "welcome", "admin", "sekretariat", "empfang", "verkauf", "sales", "service", "team", "buero", "bureau", "zentrale", "anfrage", "inquiry"))}) then 'generic' else 'seen' end as kind from first_ f join sites using (uid)),
    box as (select uid, arg_min(email, slot) as email, arg_min(url, slot) as url from kinds where kind = 'generic' group by uid), off as (select uid, arg_min(email, slot) as email, arg_min(url, slot) as url from kinds where kind = 'third_party' group by uid),
    named as (select p.*, email is not null and email not like '%@' || domain as offsite, row_number() over (partition by p.uid order by email is null or email not like '%@' || domain, {_rank_sql("role")}, pos) as k from people p join sites using (uid) where name <> 'Anna'),
    said as (select uid, list(concat_ws(', ', name, role, email) order by k) filter (where k > 1) as alternatives from named group by uid),
    newest as (select * from (select *, rank() over (partition by uid, name order by published desc) as r from notices where uid not in (select uid from named)) x where r = 1 and not departed),
    current_ as (select * from newest qualify row_number() over (partition by uid, name order by pos) = 1),
    reg as (select *, row_number() over (partition by uid order by {_rank_sql("role")}, published desc, pos) as k from current_), reg_said as (select uid, list(concat_ws(', ', name, role) order by k) filter (where k > 1) as alternatives from reg group by uid),
    j as (select s.*, p.name as p_name, p.role as p_role, p.email as p_email, p.offsite, n.name as n_name, n.role as n_role, n.url as n_url, n.published, b.email as b_email, b.url as b_url, o.email as o_email, o.url as o_url, l.url as l_url,
        coalesce((select arg_min(url, pos) from docs d where d.uid = s.uid and contains(lower(d.text), lower(p.name))), s.site) as name_at, (select arg_min(url, pos) from docs d where d.uid = s.uid and contains(lower(d.text), lower(p.email))) as email_at,
        case when p.name is not null then sa.alternatives when n.name is not null then ra.alternatives end as alternatives from sites s left join named p on p.uid = s.uid and p.k = 1 left join reg n on n.uid = s.uid and n.k = 1 left join box b on b.uid = s.uid left join off o on o.uid = s.uid left join leads l on l.uid = s.uid
        left join said sa on sa.uid = s.uid left join reg_said ra on ra.uid = s.uid),
    v as (select *, case when p_name is not null then case when p_email is not null and not offsite then 'seen' when b_email is not null then 'generic' when p_email is not null then 'third_party' when guess is not null then 'constructed' end
        when n_name is not null then case when b_email is not null then 'generic' when guess is not null then 'constructed' end when b_email is not null then 'generic' when o_email is not null then 'third_party' end as kind from j),
    w as (select *, case kind when 'seen' then p_email when 'generic' then b_email when 'constructed' then 'info@' || guess when 'third_party' then coalesce(p_email, o_email) end as email, case when kind is null or kind = 'constructed' then l_url end as lead from v),
    rest as (select w.uid, list(k.email || ' ' || k.kind order by k.slot) as others from w join kinds k on k.uid = w.uid and k.email is distinct from w.email group by w.uid)
    select w.uid, coalesce(p_name, n_name) as name, case when p_name is not null then p_role else n_role end as role, email, kind as email_kind, case when p_name is null and n_name is not null then 'shab' else 'site' end as source,
        case when p_name is not null then case kind when 'seen' then coalesce(email_at, name_at) when 'generic' then b_url else name_at end when n_name is not null then n_url when kind = 'generic' then b_url when kind = 'third_party' then o_url end as source_url,
        case when p_name is null then cast(published as varchar) end as source_date, coalesce(array_to_string(alternatives, '; '), '') as alternatives, lead,
        array_to_string(list_slice(list_concat(case when email is not null and kind is not null then [email || ' ' || kind] else [] end, coalesce(others, [])), 1, 8), ', ') as addresses
    from w left join rest using (uid) where p_name is not null or n_name is not null or email is not null or lead is not null"""


@_query(_CONTACTS)
def q_contact_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom to write to at each supplier as a company."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "customer", "documents", "orders")}

    def made(said: str) -> DataFrame:
        for n in t:
            said = said.replace(f"from {n}", f"from {{{n}}}")
        return spark.sql(said, **{n: df for n, df in t.items() if f"{{{n}}}" in said})

    apex = lambda h: urls.apex(h, suffixes=("example.com", "example.net", "example.org"))
    inbox = lambda u: F.when(F.regexp_replace(urls.host(u), r"^www\.", "") == apex(urls.host(u)), apex(urls.host(u)))
    found = contact_choice.contact_choice(made(_SITES), made(_PEOPLE), made(_PAGES), made(_NOTICES), made(_LEADS), lambda x: text.page_addresses(x, noise=True), _domain, inbox, apex)
    listed = F.array_join(F.transform("addresses", lambda a: F.concat(a["email"], F.lit(" "), a["kind"])), ", ")
    return found.withColumns({"alternatives": F.array_join("alternatives", "; "), "addresses": listed, "source_date": F.col("source_date").cast("string")})


#: Answers recorded of pages: a third of them lead to another page, a third to one without its scheme or to a folder beside them, some to a machine of one's own.
_RECORDED = """select url, case when length(html) % 13 = 0 then 404 when length(html) % 3 = 0 then 200 else 301 end as status, case when length(html) % 13 = 0 or length(html) % 3 = 0 then null when length(html) % 17 = 0 then concat('http://10.0.0.', cast(page_id % 250 as varchar(9)), '/x')
    when length(html) % 3 = 1 then target when length(html) % 6 = 2 then regexp_replace(target, '^[a-z]+:', '') else '../../../y' end as location from (select p.url, p.html, p.page_id, t.url as target from pages p cross join (select count(*) as n from pages) c join pages t on t.page_id = (p.page_id * 7 + 3) % n) x"""


@_query(
    f"""with recursive recorded as (select * from ({_RECORDED}) r qualify row_number() over (partition by url order by location) = 1),
    walk(url, final_url, hops, status, error, open_) as (select url, url, 0, null::int, null::varchar, true from pages
        union all select w.url, case when r.location is not null and w.hops < 5 then case when r.location like 'http%' then r.location when r.location like '//%' then regexp_extract(w.final_url, '^([^:]*:)', 1) || r.location else regexp_extract(w.final_url, '^([a-z]+://[^/?#]*)', 1) || '/y' end
            when r.location is not null then case when r.location like 'http%' then r.location when r.location like '//%' then regexp_extract(w.final_url, '^([^:]*:)', 1) || r.location else regexp_extract(w.final_url, '^([a-z]+://[^/?#]*)', 1) || '/y' end else w.final_url end,
            w.hops + case when g.bad is null and r.location is not null then 1 else 0 end, case when g.bad is null then case when r.location is null then r.status end end,
            case when g.bad is not null then g.bad when r.status is null then 'no answer is recorded' when r.location is not null and w.hops = 5 then 'more than 5 redirects' when r.location is not null then null when r.status >= 400 then 'HTTP ' || r.status end,
            g.bad is null and r.location is not null and w.hops < 5
        from walk w left join lateral (select case when w.final_url like 'http://10.%' then 'refused ' || regexp_extract(w.final_url, '://([^/]*)', 1) || ': not a public address' end as bad) g on true left join recorded r on r.url = w.final_url and g.bad is null where w.open_)
    select url, final_url, hops, status, error from walk where not open_"""
)
def q_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page's address leads, over recorded answers. Of a url's answers with the same location, the first recorded one (least page_id) counts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    recorded = spark.sql(_RECORDED.replace("select url,", "select url, page_id,", 1).replace("from pages", "from {pages}").replace("join pages", "join {pages}"), pages=pages)
    one = recorded.groupBy("url").agg(F.min(F.struct(F.col("location").isNull().alias("none"), "location", "page_id", "status")).alias("x")).select("url", "x.status", "x.location")
    return fetching.followed(pages, one)


def _model(text: str, attempt: int) -> dict:
    """A model that answers by the length of what it is asked: well, with another type, cut off, not at all, or well the second time."""
    n = len(text)
    kind = n % 7
    if kind == 4:
        raise TimeoutError("silent")
    if kind == 5 and attempt == 1 or kind == 6:
        return {"status": 503 if kind == 5 else 404}
    said = json.dumps({"score": n % 11 if kind != 1 else "high", "reasons": [f"because of {n}"]})
    return {"text": said[: -3 if kind == 2 else None], "finish_reason": "length" if kind == 2 else "stop", "model": "m1", "prompt_tokens": n, "completion_tokens": len(said)}


@_query(
    """with n as (select doc_id, length(text) as n, length(text) % 7 as k from documents)
    select cast(doc_id as varchar) as key, case when k in (0, 3, 5) then n % 11 end as score, case when k in (0, 3, 5) then 'because of ' || n end as reason, case when k in (1, 4) then 'unusable' when k = 2 then 'truncated' when k = 6 then 'rejected' end as error_kind,
        case k when 1 then 'no usable answer after 2 attempts: answer.score is no int' when 4 then 'no usable answer after 2 attempts: TimeoutError: silent' when 2 then 'cut off at 4096 tokens' when 6 then 'status 404' end as error_text,
        case when k in (0, 2, 3, 5) then 'm1' end as model, 'v3' as prompt_version, case when k in (0, 2, 3, 5) then n end as prompt_tokens, case when k in (0, 3, 5) then 'stop' when k = 2 then 'length' when k = 6 then '' end as finish_reason, case when k in (1, 4, 5) then 2 else 1 end as attempts from n"""
)
def q_typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed answer about each document, of a model whose answers hang on the length of the text."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("prompt_text"))
    told = answers.typed_answers(rows, _model, "score int not null, reasons array<string>", "score", "v3")
    return told.select("key", "answer.score", F.get("answer.reasons", F.lit(0)).alias("reason"), "error_kind", "error_text", "model", "prompt_version", "prompt_tokens", "finish_reason", "attempts")
