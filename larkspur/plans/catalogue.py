"""The queries that users ask, over the relations of a folder, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drafts, gazette, html, ids, text, urls
from ..operators import candidates, contacts, decisions, eligibility, ledger, report, upsert
from ..sources import shared
from ..sources.driver_tables import relations, with_relations

SETTING = eligibility.Setting("O", "1-URGENT", ("m0", "m1"), "c1", 5)
RUN = "r1"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_FITS = "goal = 'O' and prompt = '1-URGENT' and model in ('m0', 'm1') and criteria is not distinct from 'c1'"
_DRAWABLE = f"""best as (select uid, max(score) as score from scores where {_FITS} group by uid),
    open_ as (select c.uid, b.score from companies c join best b on b.uid = c.uid where c.screen_reason is null and b.score >= 5
        and not exists (select 1 from seen s where s.uid = c.uid and s.run_id = '{{run}}') and not exists (select 1 from ledger l where l.uid = c.uid) and not exists (select 1 from suppression x where x.uid = c.uid)
        and (not exists (select 1 from seen s where s.uid = c.uid)
            or (exists (select 1 from results r where r.uid = c.uid and r.error_kind is not null and r.error_kind <> 'interrupted' and r.run_id <> '{{run}}') and not exists (select 1 from results r where r.uid = c.uid and r.error_kind is null))))"""
_FOLDS = """undone as (select distinct reverses as id from ledger where status = 'undone' and reverses is not null),
    never_left as (select distinct reverses as id from ledger where status = 'not_sent' and reverses is not null and id not in (select id from undone)),
    taken_back as (select distinct reverses as id from ledger where status in ('not_sent', 'bounced') and reverses is not null and id not in (select id from undone))"""
_CURRENT = """live as (select *, row_number() over (partition by uid order by id desc) as k from ledger where id not in (select id from undone) and not (status = 'undone' and reverses is not null)),
    current_ as (select uid, id, status from live where k = 1 and status not in ('undone', 'not_sent', 'bounced'))"""
_ALL = ("companies", "scores", "seen", "results", "ledger", "suppression")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(names: tuple[str, ...], more: str = "", run: str = RUN) -> str:
    return with_relations(*names).rstrip() + (f", {more.replace('{run}', run)} " if more else " ")


_STATUS = (
    _with(_ALL, _DRAWABLE, run="")
    + """, newest as (select uid, status, row_number() over (partition by uid order by id desc) as k from ledger),
    f as (select c.municipality, c.screen_reason is null as kept, c.uid in (select uid from best) as scored, c.uid in (select uid from open_) as free, c.uid in (select uid from seen) as drawn,
        c.uid in (select uid from ledger where status = 'sent') as sent, c.uid in (select uid from results where recommendation = 'send') and c.uid not in (select uid from newest where k = 1 and status <> 'undone') as undecided from companies c)
    select municipality, count(*) as pooled, count(*) filter (where kept) as kept, count(*) filter (where kept and scored) as scored, count(*) filter (where free) as drawable, count(*) filter (where drawn) as drawn,
        count(*) filter (where sent) as sent, count(*) filter (where undecided) as undecided from f group by """
)


@_query(_STATUS + "municipality")
def q_status_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.status_by_group(relations(spark, sf_dir), SETTING)


@_query(_STATUS + "rollup (municipality)")
def q_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.status_totals(relations(spark, sf_dir), SETTING)


@_query(_with(_ALL, _DRAWABLE) + "select uid, score from open_")
def q_drawable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.drawable(relations(spark, sf_dir), SETTING, RUN)


@_query(_with(_ALL, _DRAWABLE) + "select uid, score from open_ order by score desc, sha256(cast(uid as varchar) || 'seed') limit 20")
def q_draw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.draw_batch(relations(spark, sf_dir), SETTING, RUN, 99, 20, "seed")


@_query(_with(("companies", "scores", "seen"), f"best as (select uid, max(score) as score from scores where {_FITS} group by uid)") + "select s.uid, b.score from seen s left join best b on b.uid = s.uid where run_id = 'r1' and batch_no = 1")
def q_draw_batch_on_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.draw_batch(relations(spark, sf_dir), SETTING, RUN, 1, 20, "seed")


_KINDS = f"""f as (select uid, bool_or({_FITS}) as a, bool_or(goal = 'O' and prompt = '1-URGENT' and model in ('m0', 'm1')) as b, bool_or(goal = 'O' and model in ('m0', 'm1')) as c, bool_or(goal = 'O') as d from scores group by uid),
    k as (select case when a then 'current' when b then 'earlier_criteria' when c then 'other_prompt' when d then 'other_model' else 'unscored' end as kind from companies left join f using (uid) where screen_reason is null)"""


@_query(_with(("companies", "scores"), _KINDS) + "select kind, count(*) as n from k group by kind")
def q_pool_standing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return eligibility.standing_kinds(t["companies"], t["scores"], SETTING)


@_query(_with(("companies", "scores")) + f"select max(score) as best, count(distinct uid) filter (where score >= 5) as clear from scores join companies using (uid) where screen_reason is null and {_FITS}")
def q_best_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return eligibility.best_and_clear(t["companies"], t["scores"], SETTING)


@_query(
    _with(_ALL, _DRAWABLE + ", " + _KINDS, run="")
    + f"""select (select count(*) from companies) as pooled, (select count(*) from k) as kept, {", ".join(f"(select count(*) from k where kind = '{x}') as {x}" for x in ("current", "earlier_criteria", "other_prompt", "other_model", "unscored"))},
    (select max(score) from scores join companies using (uid) where screen_reason is null and {_FITS}) as best, (select count(distinct uid) filter (where score >= 5) from scores join companies using (uid) where screen_reason is null and {_FITS}) as clear,
    (select count(*) from open_) as drawable, (select string_agg(distinct prompt, ',' order by prompt) from scores where goal = 'O' and model in ('m0', 'm1') and prompt <> '1-URGENT') as other_prompts"""
)
def q_pool_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.standing(relations(spark, sf_dir), SETTING)


@_query(_with(("companies", "scores")) + f"select uid, name, municipality from companies c where screen_reason is null and not exists (select 1 from scores s where s.uid = c.uid and {_FITS})")
def q_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return eligibility.unscored(t["companies"], t["scores"], SETTING).select("uid", "name", "municipality")


@_query(_with(("scores",)) + "select count(distinct uid) as scored from scores where " + _FITS)
def q_count_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir)["scores"].where(SETTING.fits()).agg(F.count_distinct("uid").alias("scored"))


def _ledger_query(name: str, of: Callable[[DataFrame], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return of(relations(spark, sf_dir)["ledger"])

    run.__name__ = name
    _query(_with(("ledger",), _FOLDS + ", " + _CURRENT) + sql)(run)


_ledger_query("q_undone", ledger.undone_ids, "select id from undone")
_ledger_query("q_never_left", ledger.never_left, "select id from never_left")
_ledger_query("q_taken_back", ledger.taken_back, "select id from taken_back")
_ledger_query("q_current_decision", ledger.current_decision, "select uid, id, status from current_")
_ledger_query("q_was_contacted", ledger.was_contacted, "select distinct uid from ledger where status = 'sent' and id not in (select id from taken_back)")
_ledger_query("q_reported_mails", lambda x: ledger.reported_mails(x).select("uid", "id"), "select uid, max(id) as id from ledger where status = 'sent' and id not in (select id from never_left) group by uid")
_ledger_query("q_logged_mails", lambda x: ledger.logged_mails(x).select("uid", "id"), "select uid, max(id) as id from ledger where status = 'sent' and id not in (select id from taken_back) group by uid")
_ledger_query("q_decided", ledger.decided, "select uid from (select uid, status, row_number() over (partition by uid order by id desc) as k from ledger) t where k = 1 and status <> 'undone'")
_ledger_query("q_newest_decision", lambda x: ledger.newest(x).select("id", "uid", "status"), "select id, uid, status from ledger order by id desc limit 1")
_ledger_query("q_sent_by_month", contacts.sent_by_month, "select strftime(decided_at, '%Y-%m') as month, count(*) as sent from ledger where status = 'sent' group by 1")


@_query(_with(("companies", "ledger", "suppression"), _FOLDS + ", " + _CURRENT) + "select c.uid, case when c.uid in (select uid from suppression) then 'suppressed' else x.status end as reason from companies c left join current_ x on x.uid = c.uid")
def q_closed_because(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return ledger.closed_because(t["companies"], t["ledger"], t["suppression"])


@_query(
    _with(("companies", "ledger", "suppression"), _FOLDS)
    + """select uid, case when uid in (select uid from suppression) then 'suppressed' when uid in (select uid from ledger where status = 'never') then 'never'
    when uid in (select uid from ledger where status = 'sent' and id not in (select id from taken_back)) then 'contacted' end as reason from companies"""
)
def q_off_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return ledger.off_limits_because(t["companies"], t["ledger"], t["suppression"])


def _report_sql(keys: tuple[str, ...]) -> str:
    inside = lambda c: f"{c} is not null and date_diff('day', cast(decided_at as date), cast({c} as date)) between 0 and 21"
    named = ", ".join(f"coalesce({k}, '-') as {k}" for k in keys)
    return (
        _with(("ledger", "suppression", "responses"), _FOLDS)
        + f""", m as (select *, row_number() over (partition by uid order by id desc) as k from ledger where status = 'sent' and id not in (select id from never_left)),
    back as (select distinct reverses as id from ledger where status = 'bounced' and reverses is not null and id not in (select id from undone)),
    g as (select {named}, count(*) as sent, count(*) filter (where m.id in (select id from back)) as bounced, count(*) filter (where m.uid in (select uid from suppression) or m.uid in (select uid from ledger where status = 'never')) as never,
        count(*) filter (where {inside("started_at")}) as started, count(*) filter (where {inside("completed_at")}) as completed from m left join responses r on r.uid = m.uid where k = 1 group by {", ".join(str(k + 1) for k in range(len(keys)))}) """
    )


@_query(_report_sql(("frame_version", "arm", "contact_kind")) + "select *, sent - bounced as delivered from g")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.report(t["ledger"], t["suppression"], t["responses"])


@_query(
    _report_sql(("arm",))
    + """, d as (select *, sent - bounced as delivered, completed / (sent - bounced) as p, cast(sent - bounced as double) as n from g)
    select arm, sent, bounced, never, started, completed, delivered, round(case when n = 0 then 0 else greatest(0.0, least(1.0, (p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n))) end, 6) as low,
    round(case when n = 0 then 0 else greatest(0.0, least(1.0, (p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n))) end, 6) as high from d"""
)
def q_report_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.with_intervals(report.report(t["ledger"], t["suppression"], t["responses"], ("arm",)))


@_query(_with(("ledger", "responses", "invites"), _FOLDS) + "select cast(uid as varchar) as tag from responses where uid not in (select uid from ledger where status = 'sent' and id not in (select id from never_left)) and cast(uid as varchar) not in (select code from invites)")
def q_unmatched_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.unmatched(t["responses"], t["ledger"], t["invites"])


_RAW = "select case when user_id % 9 = 0 then '' else concat(' c', cast(user_id % 40 as varchar(9))) end as tag, case when event_type = 'view' then ts end as started, case when event_type in ('signup', 'click') then ts end as completed from {events} where event_type in ('view', 'signup', 'click')"


@_query(f"select upper(trim(tag)) as tag, min(coalesce(started, completed)) as started, max(completed) as completed from ({_RAW.replace('{events}', 'events')}) t where trim(tag) <> '' group by 1")
def q_responses_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.merged_responses(spark.sql(_RAW, events=spark.read.parquet(f"{sf_dir}/events.parquet")))


_ANSWER = "case when completed_at is not null then 'completed' when started_at is not null then 'started' else 'not yet' end"


@_query(
    _with(("companies", "ledger", "responses", "invites", "contacts"), _FOLDS)
    + f""", mails as (select distinct uid from ledger where status = 'sent' and id not in (select id from taken_back)), p as (select uid, person, row_number() over (partition by uid order by id desc) as k from contacts)
    select 'link' as kind, code as tag, coalesce(name, cast(i.uid as varchar)) as company, person, {_ANSWER} = 'not yet' as removable, {_ANSWER} as answer from invites i left join responses r on r.uid = i.uid left join companies c on c.uid = i.uid
    union all select 'mail', cast(m.uid as varchar), coalesce(name, cast(m.uid as varchar)), person, false, {_ANSWER} from mails m left join p on p.uid = m.uid and k = 1 left join companies c on c.uid = m.uid left join responses r on r.uid = m.uid"""
)
def q_contact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.contact_log(relations(spark, sf_dir))


@_query(
    _with(("companies", "seen", "results"))
    + """select u.uid, s.batch_no, c.name, case when r.uid is null then 'waiting' when error_kind = 'interrupted' then 'running' when error_kind is not null then 'failed' else recommendation end as state
    from (select uid from seen where run_id = 'r1' union select uid from results where run_id = 'r1') u join companies c on c.uid = u.uid left join seen s on s.uid = u.uid and s.run_id = 'r1' left join results r on r.uid = u.uid and r.run_id = 'r1'"""
)
def q_run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.run_progress(relations(spark, sf_dir), RUN)


@_query(_with(("results",)) + "select run_id, count(*) as n, count(*) filter (where recommendation = 'send') as send, count(*) filter (where error_kind is not null) as failed, max(finished_at) as finished_at from results group by run_id")
def q_runs_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.runs_overview(relations(spark, sf_dir)["results"])


@_query(_with(("results", "ledger"), _FOLDS + ", " + _CURRENT) + "select run_id, count(*) as n from results where recommendation = 'send' and uid not in (select uid from current_) group by run_id")
def q_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.waiting(relations(spark, sf_dir))


@_query(
    _with(("results", "seen", "ledger"), _FOLDS + ", " + _CURRENT)
    + """, f as (select r.uid, case when error_kind is not null then 'error' else recommendation end as recommendation, batch_no, x.uid is not null as closed from results r left join seen s on s.uid = r.uid left join current_ x on x.uid = r.uid where r.run_id = 'r1')
    select row_number() over (order by case recommendation when 'send' then 0 when 'hold' then 1 when 'skip' then 2 else 3 end, batch_no asc nulls last, uid) as rank, uid, recommendation, batch_no, closed from f"""
)
def q_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.cards(relations(spark, sf_dir), RUN)


@_query(_with(("drafts",)) + "select uid, why from (select uid, case when frame_version <> 'f1' then 'old frame' when problems is null then 'unchecked' when problems <> '' then 'failed' end as why, row_number() over (partition by uid order by id desc) as k from drafts) t where k = 1 and why is not null")
def q_stale_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.stale_drafts(relations(spark, sf_dir), "f1")


@_query(_with(("results",)) + "select uid, error_kind from results where run_id = 'r1' and error_kind is not null")
def q_errored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.errored(relations(spark, sf_dir)["results"], RUN)


@_query(
    _with(("contacts", "suppression", "ledger"))
    + """, c as (select distinct uid, lower(trim(email)) as key from contacts), b as (select distinct key from c where uid in (select uid from suppression)), m as (select c.key, c.uid, f.id from c join (select uid, min(id) as id from ledger where status = 'sent' group by uid) f on f.uid = c.uid),
    r as (select c.uid, c.key, case when c.key in (select key from b) then 'suppressed' else (select 'sent for ' || cast(arg_min(m.uid, m.id) as varchar) from m where m.key = c.key and m.uid <> c.uid) end as reason from c) select uid, key, reason from r where reason is not null"""
)
def q_address_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return contacts.address_blocks(t["contacts"], t["suppression"], t["ledger"], ids.address_key(F.col("email")))


_NEW = "select uid, concat(name, ' neu') as name, municipality, screen_reason, uid % 3 as _order from {companies} where uid % 5 = 0 union all select uid, name, municipality + 1, screen_reason, 9 from {companies} where uid % 10 = 0"


@_query(_with(("companies",)) + f"select uid, name, municipality, screen_reason from companies where uid % 5 <> 0 union all select uid, name, municipality, screen_reason from (select *, row_number() over (partition by uid order by _order desc) as k from ({_NEW.replace('{companies}', 'companies')}) n) t where k = 1")
def q_upsert_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["companies"]
    return upsert.upsert(rows, spark.sql(_NEW, companies=rows), ["uid"])


@_query(_with(("results",)) + "select run_id, uid, recommendation from results union all select distinct 'r1', uid, 'hold' from results where uid not in (select uid from results where run_id = 'r1')")
def q_insert_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["results"].select("run_id", "uid", "recommendation")
    return upsert.insert_or_ignore(rows, rows.select(F.lit("r1").alias("run_id"), "uid", F.lit("hold").alias("recommendation")), ["run_id", "uid"])


@_query(_with(("results",)) + "select run_id, uid, 'send' as recommendation, coalesce(case when uid % 2 = 0 then cast(7 as int) end, needs_js) as needs_js from results where run_id = 'r2' union all select run_id, uid, recommendation, needs_js from results where run_id <> 'r2'")
def q_upsert_keeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["results"].select("run_id", "uid", "recommendation", "needs_js")
    new = rows.where("run_id = 'r2'").select("run_id", "uid", F.lit("send").alias("recommendation"), F.when(F.col("uid") % 2 == 0, 7).alias("needs_js"))
    return upsert.upsert_keeping(rows, new, ["run_id", "uid"], ["needs_js"])


@_query(_with(("searches",)) + "select id, uid, provider from searches where uid not in (select uid from searches where provider = 'F') union all select -id, uid, 'new' from searches where provider = 'F'")
def q_replace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["searches"].select("id", "uid", "provider")
    return upsert.replace_groups(rows, rows.where("provider = 'F'").select((-F.col("id")).alias("id"), "uid", F.lit("new").alias("provider")), ["uid"])


_UID = "concat('CHE-', lpad(cast(c_custkey % 1000 as varchar(9)), 3, '0'), '.', lpad(cast(c_custkey * 7 % 1000 as varchar(9)), 3, '0'), '.', lpad(cast(c_custkey * 13 % 1000 as varchar(9)), 3, '0'))"
_CUSTOMERS = "(select *, {u} as written from customer)".replace("{u}", _UID)
_SUM = " + ".join(f"cast(substr(d, {k + 1}, 1) as int) * {w}" for k, w in enumerate(ids.UID_WEIGHTS))
_VALID = f"(11 - ({_SUM}) % 11 <> 10 and cast(substr(d, 9, 1) as int) = (case when ({_SUM}) % 11 = 0 then 0 else 11 - ({_SUM}) % 11 end))"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select * from " + _CUSTOMERS.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


@_query(f"select c_custkey as uid, {_VALID} as valid, 'CHE' || d as compact from (select c_custkey, replace(replace(replace(written, 'CHE', ''), '-', ''), '.', '') as d from {_CUSTOMERS} t) x")
def q_uid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select(F.col("c_custkey").alias("uid"), ids.is_valid_uid(F.col("written")).alias("valid"), ids.normalised_uid(F.col("written")).alias("compact"))


@_query(f"select c_custkey as uid, case when {_VALID} then 'CHE' || d else '' end as found from (select c_custkey, replace(replace(replace(written, 'CHE', ''), '-', ''), '.', '') as d from {_CUSTOMERS} t) x")
def q_uid_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Impressum "), "written", F.lit(" MWST und nochmals "), "written")
    return _written(spark, sf_dir).select(F.col("c_custkey").alias("uid"), F.array_join(ids.find_uids(said), ",").alias("found"))


@_query("select c_custkey as uid, case when instr('02468ace', right(sha256(cast(c_custkey as varchar)), 1)) > 0 then 'voll' else 'kurz' end as arm, substr(sha256(lower(c_name)), 1, 12) as goal_hash from customer")
def q_arm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("uid"), ids.arm(F.col("c_custkey")).alias("arm"), ids.goal_hash(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("goal_hash"))


_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_DOMAIN = f"regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1)"


@_query(f"select page_id, {_HOST} as host, {_DOMAIN} as domain, regexp_extract(url, '^([a-z]+)', 1) || '://' || {_HOST} || '/' as root, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '^www[.]', '') as key from (select page_id, url from pages) p")
def q_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    key = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://|[?#].*$", ""), r"^www\.", "")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.host(url).alias("host"), urls.registered_domain(url).alias("domain"), urls.site_root(url).alias("root"), key.alias("key"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("pos"), (F.col("page_id") % 20).alias("query"), "url", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.registered_domain(url).alias("domain"))


_PAGES = f"p as (select page_id as pos, page_id % 20 as query, url, {_HOST} as host, {_PATH} as path, {_DOMAIN} as domain from pages)"


@_query(f"with {_PAGES} select query, domain, min(pos) as pos, arg_min(url, (case when regexp_replace(host, '^www[.]', '') = domain then 0 else 1 end) * 1000000000 + pos) as url from p group by query, domain")
def q_site_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.dedupe_sites(_pages(spark, sf_dir), ["query"])


@_query(
    f"""with {_PAGES}, b as (select *, regexp_matches(url, '[?]') as bulk, len(list_filter(string_split(path, '/'), lambda x: x <> '')) as depth from p)
    select query, pos, rank from (select query, pos, row_number() over (partition by query order by bulk, case when not bulk then depth end, case when not bulk then length(url) end, pos) as rank from b) t where rank <= 5"""
)
def q_prune_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pruned(_pages(spark, sf_dir).withColumn("bulk", F.col("url").contains("?")), ["query"], 5).select("query", "pos", "rank")


_KIND_URL = "concat('https://www.muster.ch/', case page_id % 7 when 0 then 'impressum' when 1 then 'de/Kontakt-anfahrt' when 2 then 'shop/kontaktlinsen' when 3 then 'about/team' when 4 then 'produkte/steamer-pro' when 5 then 'ueber-uns' else 'x' end)"


@_query(f"select page_id, case when regexp_matches(lower(u), '/impressum') then 0 when regexp_matches(lower(u), '/kontakt-') then 1 when regexp_matches(u, 'about|ueber-uns') then 2 end as kind from (select page_id, {_KIND_URL} as u from pages) t")
def q_page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.page_kind(F.expr(_KIND_URL)).alias("kind"))


_MAIL = "'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'"


@_query(f"select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_MAIL}), lambda x: lower(x)))), ',') as addresses, '' as without_noise from documents where regexp_matches(text, {_MAIL})")
def q_page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda noise: F.array_join(F.sort_array(text.page_addresses(F.col("text"), noise=noise)), ",")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(text.EMAIL)).select("doc_id", found(True).alias("addresses"), found(False).alias("without_noise"))


_PURPOSE = "concat(case doc_id % 4 when 0 then 'Handel mit Immobilien' when 1 then 'Herstellung von Maschinen und Immobilien' when 2 then 'Halten von Grundeigentum.' else 'Beratung' end, ' ', source, case when doc_id % 3 = 0 then '' else ' Die Gesellschaft kann Liegenschaften erwerben.' end)"
_NAMED = "case when doc_id % 11 = 0 then 'Muster AG in Liquidation' else 'Muster AG' end"


@_query(
    f"""select doc_id, trim(replace(p, ' Die Gesellschaft kann Liegenschaften erwerben.', '')) as head, case when n like '%Liquidation' then 'in liquidation' when doc_id % 4 in (0, 2) then 'property only' end as reason
    from (select doc_id, {_PURPOSE} as p, {_NAMED} as n from documents) t"""
)
def q_head_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_PURPOSE).alias("p"), F.expr(_NAMED).alias("n"))
    return rows.select("doc_id", text.head_clause(F.col("p")).alias("head"), text.screen_reason(F.col("n"), F.col("p")).alias("reason"))


_ANSWERS = "select o_orderkey as pos, o_custkey as uid, cast(case when o_custkey % 9 = 0 then 11 + o_orderkey % 3 else o_orderkey % 13 end as int) as score from {orders}"
_ASKED = "select c_custkey as uid from {customer} where c_mktsegment <> 'BUILDING'"
_GOOD = f"good as (select pos, uid, score from (select *, row_number() over (partition by uid order by pos) as k from ({_ANSWERS.replace('{orders}', 'orders')}) a where score between 0 and 10 and uid in (select c_custkey from customer where c_mktsegment <> 'BUILDING')) t where k = 1)"


def _validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer")}
    return candidates.validated_scores(spark.sql(_ANSWERS, orders=t["orders"]), spark.sql(_ASKED, customer=t["customer"]))


@_query(f"with {_GOOD} select pos, uid, score from good")
def q_score_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir)[0]


@_query(f"with {_GOOD} select c_custkey as uid from customer where c_mktsegment <> 'BUILDING' and c_custkey not in (select uid from good)")
def q_score_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir)[1]


_JUDGED = "select quality = 1 as deserved, n_chars % 10 >= 4 as chosen, d.doc_id as uid, cast(n_chars % 11 as int) as score, cast((n_chars + quality) % 11 as int) as human from {documents} d join {labels} l on l.doc_id = d.doc_id"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_JUDGED, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels")})


_J = _JUDGED.replace("{", "").replace("}", "")


@_query(f"select h as hits, round(h / c, 6) as precision, round(h / d, 6) as recall from (select count(*) filter (where chosen and deserved) as h, count(*) filter (where chosen) as c, count(*) filter (where deserved) as d from ({_J}) j) t")
def q_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.decision_metrics(_judged(spark, sf_dir))


@_query(
    f"""with j as ({_J}) select round(avg(score - human), 6) as bias, round(avg(abs(score - human)), 6) as mae, count(*) filter (where score = human) as exact,
    (select count(*) from (select uid from j order by score desc, uid limit 10) a where uid in (select uid from (select uid from j order by human desc, uid limit 10) b)) as top_overlap from j"""
)
def q_trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.trial_metrics(_judged(spark, sf_dir), 10)


_NOTICES = "select concat(role, cast(conv_id % 50 as varchar(9))) as name, conv_id % 7 as published, conv_id * 100 + turn as pos, turn % 3 = 1 as departed from {conversations}"


@_query(f"with n as ({_NOTICES.replace('{conversations}', 'conversations')}), r as (select *, rank() over (partition by name order by published desc) as r from n) select name, published, min(pos) as pos from r where r = 1 and not departed group by name, published")
def q_gazette_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = spark.sql(_NOTICES, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return candidates.current_notices(notices).select("name", "published", "pos")


@_query()
def q_textify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", html.page_parts("html", "url").alias("x"))
    return pages.select("page_id", F.col("x.said").alias("text"), F.struct("x.imprint", "x.legal", "x.about").alias("links"), F.col("x.organisation").alias("schema_org"))


@_query()
def q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalised("text").alias("normalised"))


@_query(
    """select c_custkey as uid, ['Dr.', 'Prof.', '', ''][c_custkey % 4 + 1] as title, array_to_string([['Anna'], ['Urs'], ['Hans', 'Peter'], []][c_custkey % 4 + 1] || case when c_custkey % 4 = 2 and c_custkey % 3 = 1 then ['Muster'] when c_custkey % 4 = 3 and c_custkey % 3 <> 0 then [['Muster'], ['Probe-Keller']][c_custkey % 3] when c_custkey % 4 = 3 then ['von'] else [] end, ' ') as given,
    case when c_custkey % 4 = 3 and c_custkey % 3 = 0 then 'Arx' when c_custkey % 4 = 3 or c_custkey % 4 = 2 and c_custkey % 3 = 1 then null else ['von Arx', 'Muster', 'Probe-Keller'][c_custkey % 3 + 1] end as surname from customer"""
)
def q_split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat(element_at(array('Dr. Anna ', 'Prof. Urs ', 'Hans Peter ', ''), cast(c_custkey % 4 as int) + 1), element_at(array('von Arx', 'Muster', 'Probe-Keller'), cast(c_custkey % 3 as int) + 1))")
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uid"), text.split_name(name).alias("name"))
    return found.select("uid", "name.title", F.array_join("name.given", " ").alias("given"), "name.surname")


@_query("select conv_id, turn, 'Anna Muster' as name, 'Direktorin' as role, false as departed from conversations union all select conv_id, turn, upper(role[1]) || role[2:] || ' Probe', 'Mitglied', true from conversations")
def q_parse_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    notice = F.expr("concat('Eingetragene Personen: Muster, Anna, von Bern, in Thun, Direktorin, mit Einzelunterschrift; Treu AG (CHE-100.000.0', cast(conv_id % 10 as string), '), Revisionsstelle. Ausgeschiedene Personen: Probe, ', initcap(role), ', Mitglied.')")
    found = F.explode(gazette.parse_persons(notice)).alias("p")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", found).select("conv_id", "turn", "p.*")


@_query()
def q_sentence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(drafts.PREFIX), "text", F.lit("."))
    return shared.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.array_join(drafts.sentence_problems(said), ",").alias("problems"))


@_query(
    _with(("contacts",))
    + """select id, case when email_kind = 'third_party' then 'hold' else 'send' end as recommendation,
    case email_kind when 'third_party' then 'the only address, ' || email || ', is on another domain' when 'seen' then coalesce(person, 'nobody named') || ' at their own address on the company''s site'
    when 'generic' then coalesce(person, 'nobody named') || ' at the general inbox the site publishes' else coalesce(person, 'nobody named') || ' at info@ on the site''s domain — not seen, a guess' end as reason from contacts"""
)
def q_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    verdict = decisions.recommend(F.lit("site"), no, no, F.col("person"), F.col("email"), F.col("email_kind"), F.lit("site"))
    return relations(spark, sf_dir)["contacts"].select("id", verdict.alias("v")).select("id", "v.*")


@_query("select uid, max(id) filter (where status = 'sent') as id from (" + "select event_id as id, user_id as uid, case event_type when 'purchase' then 'sent' end as status from events) t group by uid")
def q_latest_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir)["ledger"].groupBy("uid").agg(F.max(F.when(F.col("status") == "sent", F.col("id"))).alias("id"))


@_query(
    _with(("results", "suppression", "drafts", "ledger"), _FOLDS + ", " + _CURRENT)
    + """, d as (select uid, case when frame_version <> 'f1' then 'old frame' when problems is null then 'unchecked' when problems <> '' then 'failed' end as why, row_number() over (partition by uid order by id desc) as k from drafts)
    select r.uid, coalesce(d.why, 'none') as why from results r left join d on d.uid = r.uid and d.k = 1 where run_id = 'r1' and recommendation = 'send' and r.uid not in (select uid from current_) and r.uid not in (select uid from suppression) and (d.uid is null or d.why is not null)"""
)
def q_redraft_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.redraft_candidates(relations(spark, sf_dir), RUN, "f1")


@_query(_with(("contacts", "invites", "suppression")) + "select distinct person from (select uid, person from contacts union all select uid, person from invites) p where person is not null and uid in (select uid from suppression)")
def q_held_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return contacts.held_names(t, t["suppression"])


@_query(_with(("contacts",)) + "select distinct uid from contacts where lower(trim(email)) = 'info@site7.example.com'")
def q_companies_of_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.companies_of_address(relations(spark, sf_dir), ids.address_key(F.col("email")), "info@site7.example.com")


from . import columns, more, searches, stored  # noqa: E402, F401  they add to QUERIES and SQL
