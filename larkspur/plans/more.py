"""More queries, each with its SQL: what reviewers may do, erasing, drafts and links, sites and contacts, and text rules over the tables' own columns."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, ids, mail, text, urls
from ..operators import candidates, contacts, decisions, eligibility, ledger, lifecycle, report, retention, review, sites
from ..sources import files, shared
from ..sources.driver_tables import relations
from . import run
from .catalogue import _CURRENT, _FOLDS, _query, _with

_KEY = ids.address_key
_BARRED = """keyed as (select distinct uid, lower(trim(email)) as key from contacts), barred_keys as (select distinct key from keyed where uid in (select uid from suppression)),
    mailed as (select k.key, k.uid, f.id from keyed k join (select uid, min(id) as id from ledger where status = 'sent' group by uid) f on f.uid = k.uid),
    barred as (select uid, key, reason from (select k.uid, k.key, case when k.key in (select key from barred_keys) then 'suppressed' else (select 'sent for ' || cast(arg_min(m.uid, m.id) as varchar) from mailed m where m.key = k.key and m.uid <> k.uid) end as reason from keyed k) x where reason is not null)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DECIDE = (
    _with(("requests", "companies", "contacts", "drafts", "suppression", "ledger"), f"{_FOLDS}, {_CURRENT}, {_BARRED}")
    + """, newest as (select id, uid, status, address from ledger order by id desc limit 1),
    d as (select * from (select uid, id as draft_id, frame_version as body, problems, contact_id, greeting, link, row_number() over (partition by uid order by id desc) as k from drafts) x where k = 1),
    c as (select * from (select uid, id as contact, email, person, row_number() over (partition by uid order by id desc) as k from contacts) x where k = 1),
    offered as (select uid, email, arg_max(email_kind, id) as kind from contacts group by uid, email),
    q as (select r.id, r.uid, r.action, coalesce(r.argument, '') as argument, r.to_address, r.confirmed, co.uid is not null as there, x.status as decision, x.id as decision_id, sl.address as sent_address, d.draft_id, d.body, c.email, c.person, b.reason as bar, o.kind as kind,
        case when x.status is not null then 'decided' when r.uid in (select uid from suppression) then 'suppressed' when d.body is null then 'no draft' when d.body <> 'f1' then 'old frame' when d.problems is null then 'unchecked' when d.problems <> '' then 'failed' when c.email is null then 'no address'
            when coalesce(d.contact_id <> c.contact, false) or d.greeting <> 'Guten Tag' || coalesce(' ' || c.person, '') then 'contact changed' when co.municipality % 5 = 2 then 'not approved'
            when regexp_extract(d.link, '://([^/]*)', 1) like '%.example' then 'placeholder link' when not starts_with(d.link, 'https://umfrage.ch') then 'foreign link' end as blocked,
        coalesce(r.id % 2 = 0 and d.draft_id is not null and d.body = 'f1', false) as shown, nb.uid is not null as bounce, n.id as newest_id, nb.id as bounce_id, coalesce(n.uid = r.uid and n.status = 'sent', false) as newest_sent
        from requests r left join companies co on co.uid = r.uid left join current_ x on x.uid = r.uid left join ledger sl on sl.id = x.id left join d on d.uid = r.uid left join c on c.uid = r.uid
        left join barred b on b.uid = r.uid and b.key = lower(trim(case when r.action = 'send' then r.to_address else r.argument end)) left join offered o on o.uid = r.uid and o.email = case when r.action = 'send' then r.to_address else r.argument end
        cross join newest n left join newest nb on nb.uid = r.uid and nb.status = 'bounced'),
    v as (select *, case when not there then '404 no such card'
        when action = 'send' then case when blocked is not null then '409 ' || blocked when not shown then '409 the draft changed' when kind is null then '400 not an address of the card' when kind = 'third_party' then '409 an address on another domain' when bar is not null then '409 ' || bar when to_address <> email then '409 written for another address' else '303 done' end
        when action = 'address' then case when kind is null then '400 not an address of the card' when kind = 'third_party' then '409 an address on another domain' when bar is not null then '409 ' || bar when decision is not null then '409 already decided: ' || decision when draft_id is null then '409 no draft to rebuild' else '303 done' end
        when action = 'salutation' then case when argument not in ('Frau', 'Herr', 'ohne') then '400 no such salutation' when decision is not null then '409 already decided: ' || decision when draft_id is null or person is null then '409 no draft to a named person' else '303 done' end
        when action = 'skip' then case when argument not in ('wrong company', 'wrong person', 'not now') then '400 no such reason' when decision is not null then '409 already decided: ' || decision else '303 done' end
        when action = 'never' then case when coalesce(decision in ('never', 'sent'), false) then '409 already decided: ' || decision when not confirmed then '200 confirm' else '303 done' end
        when action = 'undo' then case when not bounce and coalesce(decision, '') <> 'skipped' then '409 cannot undo ' || coalesce(decision, 'nothing') else '303 done' end
        when action = 'not_sent' then case when not newest_sent then '409 another decision came after' when not confirmed then '200 confirm' else '303 done' end
        when action = 'bounced' then case when coalesce(decision, '') <> 'sent' then '409 only a sent mail can bounce, this is ' || coalesce(decision, 'nothing') when not confirmed then '200 confirm' else '303 done' end
        else '400 no such action' end as answer from q),
    w as (select *, case when answer = '303 done' then case action when 'send' then 'sent' when 'skip' then 'skipped' when 'undo' then 'undone' when 'never' then 'never' when 'not_sent' then 'not_sent' when 'bounced' then 'bounced' end end as status,
        case when answer = '303 done' then case action when 'undo' then bounce_id when 'not_sent' then newest_id when 'bounced' then decision_id end end as reverses, case when answer = '303 done' then case action when 'send' then to_address when 'bounced' then sent_address end end as address from v)"""
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    last, draft = t["ledger"].agg(F.max("id").alias("sent_id")), ledger.latest(t["drafts"]).select("uid", F.when(F.col("frame_version") == "f1", F.col("id")).alias("_draft"))
    shown = t["requests"].join(F.broadcast(last)).join(draft, "uid", "left").withColumn("shown_draft", F.when(F.col("id") % 2 == 0, F.col("_draft"))).withColumn("shown_body", F.sha2(F.lit("f1"), 256)).withColumn("argument", F.coalesce("argument", F.lit(""))).drop("_draft")
    return review.answered(shown, review.card_states(t, "f1", _KEY(F.col("email")), "https://umfrage.ch/", F.col("municipality") % 5 != 2), F.lower(F.trim("_to")))


@_query(_DECIDE + "select id, uid, cast(substr(answer, 1, 3) as int) as code, substr(answer, 5) as said, status, reverses, address from w")
def q_decision_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("id", "uid", "code", "said", "status", "reverses", "address")


@_query(_DECIDE + "select uid, status, reverses, address from (select *, row_number() over (partition by uid order by id) as k from w where status is not null) x where k = 1")
def q_ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ledger_rows(_answers(spark, sf_dir))


@_query(_with(("ledger", "companies")) + "select coalesce(address, cast(uid as varchar)) as key, 'bounced' as reason from (select distinct address, uid from ledger where status = 'bounced' and address is not null) x where address not in (select address from ledger where status = 'sent' and id % 5 = 0 and address is not null) group by 1")
def q_after_bounces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["ledger"]
    first = review.after_bounces(spark.createDataFrame([], "key string, reason string"), rows.withColumn("undone_address", F.lit(None).cast("string")))
    back = rows.where("status = 'sent' and id % 5 = 0").select("status", F.lit(None).cast("string").alias("address"), F.col("address").alias("undone_address"))
    return review.after_bounces(first, back)


_GONE = "uid in (select uid from suppression)"
_OWN = """own as (select distinct regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+[.][^.]+)$', 1) as domain from sites where uid in (select uid from suppression)
    union select distinct regexp_extract(lower(regexp_extract(email, '([^@]*)$', 1)), '([^.]+[.][^.]+)$', 1) from contacts where email_kind <> 'third_party' and uid in (select uid from suppression)),
    pages_ as (select *, regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+[.][^.]+)$', 1) as domain from pages)"""
_TABLES = (*retention.ERASED, "suppression", "ledger", "results")


@_query(_with(_TABLES, _OWN) + " union all ".join(f"select '{n}' as table_name, count(*) as n from {n} where {_GONE}" for n in retention.ERASED) + " union all select 'pages', count(*) from pages_ where domain in (select domain from own)")
def q_erase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return retention.erase_plan(t, t["suppression"])


@_query(_with(_TABLES) + f"select run_id, uid, recommendation, case when {_GONE} then 'erased' else reason end as reason from results")
def q_erase_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return retention.erase(t, t["suppression"])["results"].select("run_id", "uid", "recommendation", "reason")


@_query(_with(_TABLES) + f"select id, uid, status, case when not {_GONE} then subject end as subject, case when not {_GONE} then address end as address from ledger")
def q_erase_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return retention.erase(t, t["suppression"])["ledger"].select("id", "uid", "status", "subject", "address")


@_query(_with(_TABLES, _OWN) + "select page_id, url from pages_ where domain not in (select domain from own)")
def q_erase_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return retention.erase(t, t["suppression"])["pages"].select("page_id", "url")


@_query(
    _with(_TABLES)
    + f"""select 'uid' as kind, cast(uid as varchar) as key from suppression union select 'address', lower(trim(address)) from ledger where status = 'sent' and address is not null and {_GONE}
    union select 'profile', 'linkedin.com/in/' || lower(rtrim(regexp_replace(replace(profile, 'https://ch.linkedin.com/in/', ''), '[?#].*$', ''), '/')) from profiles where {_GONE}"""
)
def q_forgotten_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return retention.forgotten_keys(t, t["suppression"])


@_query(
    _with((*_TABLES, "invites"))
    + f"""select kind, value from (select 'person' as kind, person as value from contacts where {_GONE} union select 'person', person from invites where {_GONE} union select 'address', email from contacts where {_GONE} union select 'address', address from ledger where {_GONE}) x where value is not null"""
)
def q_held_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return retention.held_facts(t, t["suppression"])


@_query(
    _with(("contacts", "profiles", "sites", "drafts", "searches", "seen", "ledger"))
    + """select h.uid from (select uid from contacts union select uid from profiles union select uid from sites union select uid from drafts union select uid from searches) h
    left join (select uid, max(drawn_at) as d from seen group by uid) s on s.uid = h.uid left join (select uid, max(d) as d from (select uid, created_at as d from drafts union all select uid, asked_at from searches) x group by uid) t on t.uid = h.uid
    where h.uid not in (select uid from ledger where decided_at >= date '1996-01-01') and coalesce(coalesce(s.d, t.d) < date '1996-01-01', true)"""
)
def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.stale(relations(spark, sf_dir), datetime.date(1996, 1, 1))


_CRITERIA = "'must:' || chr(10) || '  - ' || p_brand || chr(10) || 'must_not:' || chr(10) || '  - ' || p_type || chr(10) || '  - ' || p_name || chr(10) || 'positive_signals:'"


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lifecycle.criteria_text(F.array("p_brand"), F.array("p_type", "p_name"), F.array().cast("array<string>"))
    return _table(spark, sf_dir, "part").select("p_partkey", said.alias("criteria"), lifecycle.criteria_hash(said).alias("criteria_hash"))


@_query(f"select p_partkey, {_CRITERIA} as criteria, substr(sha256({_CRITERIA}), 1, 12) as criteria_hash from part")
def q_criteria_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _criteria(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F has a set, F and O get new ones."""
    goals = relations(spark, sf_dir)["scores"].select("goal").distinct()
    old = goals.where("goal = 'F'").select("goal", F.lit("old").alias("criteria_hash"), F.lit("2024-01-01").alias("created_at"))
    new = goals.where("goal <> 'P'").select("goal", F.concat(F.lit("new"), "goal").alias("criteria_hash"), F.lit("2025-01-01").alias("created_at"))
    history = spark.createDataFrame([], "goal string, criteria_hash string, created_at string, replaced_at string")
    return lifecycle.store_criteria(old, history, relations(spark, sf_dir)["scores"], new, True)


@_query(_with(("scores",)) + "select uid, goal, prompt, model, case when goal = 'O' then coalesce(criteria, 'newO') else criteria end as criteria, score from scores")
def q_scores_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[2]


@_query(_with(("scores",)) + "select distinct goal, 'new' || goal as criteria_hash, '2025-01-01' as created_at, null::varchar as replaced_at from scores where goal <> 'P' union all select distinct goal, 'old', '2024-01-01', '2025-01-01' from scores where goal = 'F'")
def q_criteria_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, history, _ = _stored(spark, sf_dir)
    return now.withColumn("replaced_at", F.lit(None).cast("string")).unionByName(history)


@_query(_with(("runs",)) + "select run_id, case when run_id = 'r1' then 'failed' when run_id = 'r2' then 'done' else 'scoring' end as status from runs")
def q_runs_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = relations(spark, sf_dir)["runs"]
    begun = lifecycle.record_run(runs.withColumn("status", F.lit("done")).withColumn("finished_at", F.lit(None).cast("timestamp")), runs)
    ended = runs.where("run_id in ('r1', 'r2')").select("run_id", (F.col("run_id") == "r1").alias("failed"), F.current_timestamp().alias("finished_at"))
    return lifecycle.finish_run(begun, ended).select("run_id", "status")


@_query(_with(("runs",)) + "select run_id, criteria from runs where goal = 'F' and criteria is not null")
def q_criteria_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.criteria_of_runs(relations(spark, sf_dir)["runs"], "F").select("run_id", "criteria")


@_query(
    _with(("drafts", "ledger"))
    + """, named as (select distinct draft_id as id from ledger where draft_id is not null), n as (select * from drafts where problems = 'too long')
    select id, uid, coalesce(problems, '-') as problems from drafts where problems is null or problems <> 'too long' or id in (select id from named) union all select id, uid, '' from n where id not in (select id from named) union all select -id, uid, '' from n where id in (select id from named)"""
)
def q_rewrite_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    rebuilt = t["drafts"].where("problems = 'too long'").select("id", (-F.col("id")).alias("new_id"), F.lit("").alias("problems"), F.lit("f2").alias("frame_version"), F.col("created_at"))
    return lifecycle.rewrite_drafts(t["drafts"], t["ledger"], rebuilt).select("id", "uid", F.coalesce("problems", F.lit("-")).alias("problems"))


@_query(_with(("contacts", "suppression")) + "select id, uid, case when k = 1 and uid in (select uid from suppression) then 'new@x.example' else email end as email, email_kind from (select *, row_number() over (partition by uid order by id desc) as k from contacts) x")
def q_update_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return lifecycle.update_latest(t["contacts"], t["suppression"].select("uid", F.lit("new@x.example").alias("email")), ["email"]).select("id", "uid", "email", "email_kind")


@_query(_with(("drafts", "suppression")) + "select id, uid, case when uid in (select uid from suppression) then 'year; link' else problems end as problems from drafts")
def q_record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return lifecycle.record_checks(t["drafts"], t["suppression"].select("uid", F.array(F.lit("year"), F.lit("link")).alias("found"))).select("id", "uid", "problems")


@_query("select c_custkey as uid, case when c_nationkey < 8 then 'first' when c_mktsegment = 'BUILDING' then null when c_nationkey < 20 then 'second' end as kept, case when c_nationkey < 8 then null when c_mktsegment = 'BUILDING' then 'no second draft' when c_nationkey < 20 then null else 'the draft failed its checks twice: year; link' end as reason from customer")
def q_drafting_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda n: F.when(F.col("c_nationkey") < n, F.array().cast("array<string>")).otherwise(F.array(F.lit("year"), F.lit("link"))).alias("found")
    rows = _table(spark, sf_dir, "customer").withColumn("uid", F.col("c_custkey"))
    return lifecycle.drafting_outcomes(rows.select("uid", found(8)), rows.where("c_mktsegment <> 'BUILDING'").select("uid", found(20)))


@_query(_with(("invites", "responses")) + "select code, uid from invites where n_notes % 2 = 0 or uid in (select uid from responses where started_at is not null or completed_at is not null)")
def q_remove_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return lifecycle.remove_invites(t["invites"], t["responses"], t["invites"].where("n_notes % 2 <> 0")).select("code", "uid")


@_query(_with(("invites",)) + "select code, uid, case when n_notes % 2 = 0 then person end as person from invites")
def q_redact_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["invites"]
    return lifecycle.redact_invites(rows, rows.where("n_notes % 2 <> 0"), ["person"])[0].select("code", "uid", "person")


@_query(_with(("invites",)) + "select count(*) as n from invites where n_notes % 2 <> 0 and person is not null")
def q_redacted_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["invites"]
    return lifecycle.redact_invites(rows, rows.where("n_notes % 2 <> 0"), ["person"])[1]


@_query(_with(("invites",)) + "select code, uid, person from invites union all select 'N' || code, uid, person from invites where n_notes % 2 = 0")
def q_record_invite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["invites"].select("code", "uid", "person")
    new = relations(spark, sf_dir)["invites"].select(F.when(F.col("n_notes") % 2 == 0, F.concat(F.lit("N"), "code")).otherwise(F.col("code")).alias("code"), "uid", "person")
    return lifecycle.record_invite(rows, new).select("code", "uid", "person")


@_query(_with(("scores",)) + "select goal, uid, cast((row_number() over (partition by goal order by uid) - 1) // 50 as bigint) as batch_no from (select distinct goal, uid from scores) x")
def q_score_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.batches(relations(spark, sf_dir)["scores"].select("goal", "uid").distinct(), "goal", 50)


@_query(_with(("results",)) + "select run_id, count(*) filter (where recommendation = 'send' and error_kind is null) as sendable from results group by run_id")
def q_count_sendable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sendable(relations(spark, sf_dir)["results"])


@_query(_with(("results",)) + "select uid, max(needs_js) as needs_js from results where run_id = 'r1' and needs_js is not null group by uid")
def q_needs_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.needs_js_by_uid(relations(spark, sf_dir)["results"], "r1")


@_query(_with(("searches",)) + "select provider, count(*) as asked, count(*) filter (where n_results = 0) as silent from searches group by provider")
def q_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.search_counts(relations(spark, sf_dir)["searches"])


@_query(_with(("searches",)) + "select uid, row_number() over (partition by uid order by asked_at, id) as at, provider, n_results from searches")
def q_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.search_log(relations(spark, sf_dir)["searches"])


@_query(_with(("companies", "results")) + "select distinct c.name from companies c join results r on r.uid = c.uid")
def q_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.company_names(t["companies"], t["results"])


@_query("select o_orderstatus as run_id, count(*) filter (where o_orderkey % 4 = 0) as cached, count(*) filter (where o_orderkey % 4 = 1) as scored, count(*) filter (where o_orderkey % 4 = 2) as dropped, count(*) filter (where o_orderkey % 4 = 3) as failed from orders group by 1")
def q_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), F.element_at(F.array(*map(F.lit, ("cached", "scored", "dropped", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("outcome"))
    return report.score_summary(rows)


@_query(
    _with(("contacts", "invites", "companies"))
    + "select uid, ref, who from (select uid, 'mail' as how, cast(id as varchar) as ref, coalesce(person, '-') as who from contacts union all select uid, 'link', code, coalesce(person, '-') from invites) x"
)
def q_earlier_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.earlier_contacts(t["contacts"], t["invites"]).select("uid", F.col("at").alias("ref"), F.coalesce("person", F.lit("-")).alias("who"))


@_query(
    _with(("seen", "results", "companies"))
    + """, p as (select c.uid, s.batch_no, c.name, case when r.uid is null then 'waiting' when r.error_kind = 'interrupted' then 'running' when r.error_kind is not null then 'failed' else r.recommendation end as state
        from (select uid from seen where run_id = 'r1' union select uid from results where run_id = 'r1') u join companies c on c.uid = u.uid left join seen s on s.uid = u.uid and s.run_id = 'r1' left join results r on r.uid = u.uid and r.run_id = 'r1')
    select uid, state, row_number() over (order by batch_no desc nulls last, case state when 'running' then 0 when 'waiting' then 1 when 'failed' then 2 else 3 end, name) as place from p"""
)
def q_progress_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.in_order_of_work(contacts.run_progress(relations(spark, sf_dir), "r1")).select("uid", "state", "place")


@_query(_with(("ledger", "contacts", "invites")) + "select (exists (select 1 from ledger where uid = 7) or exists (select 1 from contacts where uid = 7) or exists (select 1 from invites where uid = 7)) as known")
def q_uid_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.known_anywhere([t[n] for n in ("ledger", "contacts", "invites")], 7)


_NAMES = "concat('Muster ', c_name, case c_nationkey % 4 when 0 then ' AG' when 1 then ' GmbH in Liquidation' when 2 then ' Sàrl' else '' end)"
_SHORT = "concat('Muster ', c_name)"


@_query(f"""select c_custkey as uid, '"' || {_SHORT} || '" Buchs' || chr(10) || {_SHORT} || ' Impressum' || chr(10) || '"CHE-100.000.000" OR "CHE100000000"' as queries, 'site:.ch "' || {_SHORT} || '" Buchs' as narrowing, lower({_SHORT}) as canonical from customer""")
def q_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, plain = F.expr(_NAMES), F.expr(_NAMES.replace(" in Liquidation", ""))
    asked = sites.search_queries(name, F.lit("Buchs"), F.lit("CHE100000000"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.array_join(asked, "\n").alias("queries"), sites.narrowing_query(name, F.lit("Buchs")).alias("narrowing"), text.canonical_name(plain).alias("canonical"))


@_query("select n_nationkey, sha256(n_name) as body, sha1(n_name) as cache, n_name as seat, case when n_nationkey % 2 = 0 then '3203,17,' || n_nationkey end as ids from nation".replace("|| n_nationkey end", "|| (100 + n_nationkey) end"))
def q_keys_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat("n_name", F.element_at(F.array(F.lit(" AG"), F.lit(" (ZH)"), F.lit("")), (F.col("n_nationkey") % 3 + 1).cast("int")))
    numbers = ids.municipality_ids(F.array(F.lit("3203, 17"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "17,").otherwise("x,"), (100 + F.col("n_nationkey")).cast("string"))))
    return _table(spark, sf_dir, "nation").select("n_nationkey", ids.body_sha256(F.col("n_name")).alias("body"), ids.cache_key(F.col("n_name")).alias("cache"), text.seat(place).alias("seat"), F.array_join(numbers, ",").alias("ids"))


_URL_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_RESULTS = f"select page_id % 50 as uid, page_id as pos, url, case when page_id % 3 = 0 then 'brave' else 'searx' end as provider, case when page_id % 4 < 2 then 'captcha' end as refused, page_id % 8 < 1 as lasting, regexp_extract({_URL_HOST}, '([^.]+[.][^.]+)$', 1) as domain from pages"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    provider, refused = F.when(page % 3 == 0, "brave").otherwise("searx").alias("provider"), F.when(page % 4 < 2, "captcha").alias("refused")
    return _table(spark, sf_dir, "pages").select((page % 50).alias("uid"), page.alias("pos"), "url", provider, refused, (page % 8 < 1).alias("lasting"))


@_query(f"with r as ({_RESULTS}), f as (select uid, domain, min(pos) as pos, arg_min(url, pos) as url from r where domain <> '' group by uid, domain) select uid, url, rank from (select uid, url, row_number() over (partition by uid order by pos) as rank from f) x where rank <= 3")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.candidates(_results(spark, sf_dir), 3)


@_query(f"with r as ({_RESULTS}) select uid, pos from r a where not exists (select 1 from r b where b.uid = a.uid and b.domain = a.domain and b.provider = 'brave')")
def q_untried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return sites.untried(rows.select("uid", "pos", "url"), rows.where("provider = 'brave'").select("uid", "url")).select("uid", "pos")


@_query(f"with r as ({_RESULTS}) select uid, pos from r a where exists (select 1 from r b where b.uid = a.uid and b.url = a.url and b.provider <> 'brave')")
def q_storable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return sites.storable(rows.select("uid", "pos", "url"), rows, "brave").select("uid", "pos")


_REFUSED = f"with r as ({_RESULTS}), g as (select uid, bool_and(refused is not null) as every, bool_and(lasting) as lasting, string_agg(refused, ', ' order by refused) as reasons from r where uid % 2 = 0 or refused is not null group by uid), o as (select uid, case when not every then 'read' when lasting then 'every candidate refused' else 'no candidate could be read' end as outcome, case when every then reasons end as reasons from g)"


@_query(_REFUSED + "select uid, outcome, reasons, case when outcome = 'read' then null when outcome = 'every candidate refused' and uid % 3 = 0 then 'skip' else 'error' end as verdict from o")
def q_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sites.refusals(_results(spark, sf_dir).where("uid % 2 = 0 or refused is not null"))
    before = F.when(F.col("uid") % 3 == 0, "every candidate refused (captcha)")
    return read.withColumn("verdict", sites.after_refusal(F.col("outcome"), before))


@_query("select page_id, 'no website found after 3 searches and a domain guess' || case when page_id % 5 > 0 then ', ' || (page_id % 5) || ' candidate(s) checked' else '' end || case when page_id % 2 = 0 then '; Brave was also asked' else '' end as reason from pages")
def q_no_site_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    return _table(spark, sf_dir, "pages").select("page_id", sites.no_site_reason(F.lit(3), page % 5, page % 2 == 0).alias("reason"))


@_query(f"select page_id, case when {_URL_HOST} = '' then url when page_id % 2 = 0 then 'https://www.neu.ch/' else url end as url, {_URL_HOST} = 'muster.ch' as never_so, case when page_id % 3 = 0 then 'info@muster.com' when page_id % 3 = 1 then 'kontakt@mail.muster.ch' end as inbox, case when page_id % 2 = 0 then 'Anna, a@b.ch' else 'Anna, Leiterin' end as said from pages where url is not null".replace(f"case when {_URL_HOST} = '' then url when", "case when"))
def q_contact_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    found = F.when(page % 3 == 0, F.array(F.lit("anna@muster.ch"), F.lit("info@other.ch"), F.lit("info@muster.com"))).when(page % 3 == 1, F.array(F.lit("kontakt@mail.muster.ch"), F.lit("info@muster.ch"))).otherwise(F.array(F.lit("info@www.muster.com.ch"), F.lit("anna@muster.ch")))
    said = sites.described(F.lit("Anna"), F.when(page % 2 == 1, "Leiterin"), F.when(page % 2 == 0, "a@b.ch"))
    moved = sites.moved_to(F.col("url"), F.when(page % 2 == 0, "https://www.neu.ch/willkommen?x=1"))
    return _table(spark, sf_dir, "pages").where("url is not null").select("page_id", moved.alias("url"), (urls.host(F.col("url")) == "muster.ch").alias("never_so"), sites.inbox(found, F.lit("muster.ch")).alias("inbox"), said.alias("said"))


@_query("select user_id % 100 as uid, 'https://ch.linkedin.com/in/p' || min(event_id) as url from events where event_type in ('view', 'click') and event_id % 2 = 0 group by 1")
def q_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    url = F.when(F.col("event_type") == "view", F.concat(F.lit("https://ch.linkedin.com/in/p"), event.cast("string"))).when(F.col("event_type") == "click", F.concat(F.lit("https://ch.linkedin.com/in/p"), event.cast("string"))).otherwise("https://linkedin.com/company/x")
    title = F.when(event % 2 == 0, "anna muster - metallbau st. galler").otherwise("anna muster - treuhand")
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("uid"), event.alias("pos"), url.alias("url"), title.alias("title"), F.lit("st. galler metallbau").alias("company"), F.when(event % 4 == 0, "anna muster").alias("name"))
    return sites.leads(rows)


@_query("select conv_id, 'a' || (conv_id % 7) || '@x' || (turn % 2) || '.ch' as email, min(turn) as turn from conversations group by 1, 2")
def q_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.concat_ws("/", "conv_id", "turn").alias("url"), F.array(F.concat(F.lit("a"), (F.col("conv_id") % 7).cast("string"), F.lit("@x"), (F.col("turn") % 2).cast("string"), F.lit(".ch"))).alias("emails"))
    each = rows.select(F.col("conv_id"), "pos", "url", F.transform("emails", lambda e: F.concat(F.col("conv_id").cast("string"), F.lit(" "), e)).alias("emails"))
    found = sites.first_pages(each)
    return found.select(F.split("email", " ")[0].cast("long").alias("conv_id"), F.split("email", " ")[1].alias("email"), F.split("url", "/")[1].cast("int").alias("turn"))


@_query(
    """select s_suppkey, case s_suppkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as role, 'https://survey.example/?v=1&c=CHE' || s_suppkey as survey, 'K' || s_suppkey || '.ch' as host, 'generic/site/' || case when s_suppkey % 2 = 0 then 'named' else 'none' end as kind,
    case when s_suppkey % 3 = 0 then 'linkedin.com/in/' || lower(split_part(s_name, '#', 1)) end as profile, case s_suppkey % 4 when 0 then 'uid' when 1 then 'address' when 2 then 'profile' else 'error' end as key_kind, 'Ein Satz mit' as cut, s_suppkey % 2 = 0 as quoted, s_suppkey % 2 = 0 as noise from supplier"""
    .replace("'K' || s_suppkey || '.ch'", "'k' || s_suppkey || '.ch'")
)
def q_small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) if x is None or isinstance(x, str) else x for x in xs)), (key % len(xs) + 1).cast("int"))
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.role_rank(pick("Inhaberin", "Präsident des Verwaltungsrats", "Monteur", "", " ")).alias("role"), ids.survey_link("https://survey.example/?v=1", F.concat(F.lit("CHE"), key.cast("string"))).alias("survey"),
        ids.email_host(F.concat(F.lit("a@K"), key.cast("string"), F.lit(".ch"))).alias("host"), review.contact_kind(F.lit("generic"), F.lit("site"), pick("Anna", " ")).alias("kind"),
        F.when(key % 3 == 0, ids.profile_key(F.concat(F.lit(" https://www.LinkedIn.com/in/"), "s_name", F.lit("/?x=1")))).alias("profile"), ids.parsed_key(pick("CHE-116.281.710", "A@b.ch ", "https://ch.linkedin.com/in/x/", "was?"))["kind"].alias("key_kind"),
        text.truncated(F.lit("Ein Satz mit einigen Worten"), 15).alias("cut"), text.quote_found(pick("seit Jahren … in Buchs", "... seit Tagen"), F.lit("Wir bauen seit Jahren Hallen in Buchs.")).alias("quoted"), text.is_noise(pick("logo@2x.png", "anna@firma.ch")).alias("noise"),
    )


@_query("select o_orderkey, day(o_orderdate) || '. ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate) as day, 'mailto:a@b.ch?subject=' || replace(o_orderpriority, ' ', '%20') || '&body=' || o_orderkey || '%0D%0A%2A~' as link from orders")
def q_mail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.col("o_orderkey").cast("string"), F.lit("\n*~"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.german_date(F.col("o_orderdate")).alias("day"), ids.mailto(F.lit("a@b.ch"), F.col("o_orderpriority"), body)["link"].alias("link"))


@_query(
    """select c_custkey as uid, case c_nationkey % 5 when 0 then 'company missing' when 1 then 'too long,unknown channel' when 2 then 'suppressed' when 3 then 'profile has a link' else '' end as problems,
    case when c_nationkey % 3 = 0 then 'uid' when c_nationkey % 3 = 1 then 'address' else 'none' end as tier, case when c_nationkey % 2 = 0 then 'https://muster.ch/' end as site from customer"""
)
def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    is_ = lambda k: nation % 5 == k
    wrong = decisions.invite_problems(F.when(is_(0), " ").when(is_(1), F.repeat(F.lit("x"), 201)).otherwise("Muster"), F.when(is_(1), "pigeon").otherwise("mail"), is_(2), is_(3))
    page = F.when(nation % 3 == 0, "Impressum CHE-116.281.710").when(nation % 3 == 1, "Weg 3, 9470 Buchs").otherwise("9470 Bern")
    tier = decisions.site_tier(F.lit("CHE116281710"), F.lit("Weg 3"), F.lit("9470 Buchs"), page)
    site = decisions.chosen_site(F.lit("https://muster.ch/"), F.array(F.lit("https://muster.ch/"), F.lit("https://b.ch/")), F.when(nation % 2 == 0, "seit 1950").otherwise("nie gesagt"), F.lit("gebaut wird seit 1950 hier"), F.lit("none"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.array_join(wrong, ",").alias("problems"), tier.alias("tier"), site["url"].alias("site"))


@_query(
    _with(("results", "seen", "ledger"), _FOLDS + ", " + _CURRENT)
    + """, f as (select r.uid, case when error_kind is not null then 'error' else recommendation end as recommendation, batch_no, x.uid is not null as closed from results r left join seen s on s.uid = r.uid left join current_ x on x.uid = r.uid where r.run_id = 'r1'),
    k as (select row_number() over (order by case recommendation when 'send' then 0 when 'hold' then 1 when 'skip' then 2 else 3 end, batch_no asc nulls last, uid) as rank, uid, case when not closed then uid end as waits from f)
    select rank, uid, coalesce(min_by(waits, rank) filter (where waits is not null) over (order by rank rows between 1 following and unbounded following), min_by(waits, rank) filter (where waits is not null) over ()) as next_uid from k"""
)
def q_next_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.next_cards(contacts.cards(relations(spark, sf_dir), "r1"))


@_query(
    """select c_nationkey as batch_no, '[' || string_agg('{"uid":' || c_custkey || ',"name":"' || c_name || '","purpose":"' || substr(repeat(c_mktsegment || ' ', 40), 1, 300) || '"}', ',' order by c_custkey) || ']' as data from customer group by 1"""
)
def q_prompt_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("batch_no"), F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.repeat(F.concat("c_mktsegment", F.lit(" ")), 40).alias("purpose"))
    return run.prompt_data(rows)


@_query(_with(("results",)) + "select run_id, uid, case when run_id = 'r1' and error_kind is not null then 'hold' else recommendation end as recommendation from results")
def q_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["results"]
    return run.retried(rows, "r1", lambda uids: uids.withColumn("recommendation", F.lit("hold"))).select("run_id", "uid", "recommendation")


_DECISIONS = "select o_custkey as uid, o_orderdate as decided_at, case max(o_orderstatus) when 'F' then 'sent' when 'O' then 'skipped' else 'dance' end as status from {orders} group by 1, 2"


@_query(
    _with(("ledger",))
    + f"select id, uid, status from ledger union all select (select max(id) from ledger) + row_number() over (order by decided_at, uid), uid, status from ({_DECISIONS.replace('{orders}', 'orders')}) d where status <> 'dance'"
)
def q_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.sql(_DECISIONS, orders=_table(spark, sf_dir, "orders"))
    return ledger.append(relations(spark, sf_dir)["ledger"], new)[0].select("id", "uid", "status")


@_query(f"select page_id, {_URL_HOST} as host, 'https://' || {_URL_HOST} || '/a' as links, '## Impressum' || chr(10) || 'Ein Satz' || chr(10) || chr(10) || '## Start' || chr(10) || 'kurz' as said from pages where {_URL_HOST} <> ''")
def q_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.host(F.col("url"))
    links = F.array(F.concat(F.lit("https://"), host, F.lit("/a#x")), F.lit("https://else.example/b"), F.concat(F.lit("https://"), host, F.lit("/a/")), F.lit("mailto:x"))
    said = sites.prompt_text({"Impressum": F.lit("Ein Satz mit Worten"), "Kontakt": F.lit(" "), "Start": F.lit("kurz")}, 12)
    return _table(spark, sf_dir, "pages").where(host != "").select("page_id", host.alias("host"), F.array_join(sites.harvested_links(links, F.col("url")), " ").alias("links"), said.alias("said"))


@_query("select c_custkey as uid, 'https://f' || c_custkey || '.ch/' || case when c_nationkey % 3 = 0 then 'impressum' else 'contact' end as url from customer where c_nationkey % 3 <> 2")
def q_fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").withColumn("root", F.concat(F.lit("https://f"), F.col("c_custkey").cast("string"), F.lit(".ch/")))
    nation = F.col("c_nationkey")
    there = F.when(nation % 3 == 0, F.array(F.lit("about"), F.lit("impressum"))).when(nation % 3 == 1, F.array(F.lit("contact"))).otherwise(F.array().cast("array<string>"))
    pages = rows.select("root", F.explode(there).alias("path"), F.lit("Text").alias("text")).unionByName(rows.select("root", F.lit("kontakt").alias("path"), F.lit(" ").alias("text")))
    return sites.fallback_pages(rows.select(F.col("c_custkey").alias("uid"), "root"), pages.select(F.concat("root", "path").alias("url"), "text"))


_PAGE = """concat('<html><head><title>T</title><script type="application/ld+json">{"@graph": [{"@type": "Organization", "legalName": "Muster ', k, ' AG", "address": {"postalCode": "3000"}}]}</script><style>p { color: red }</style></head><body>',
    '<nav><a href="/impressum">Recht</a><a href="https://else.ch/impressum">x</a><a href="/team">Wir</a></nav><p>Hallo <b>Welt</b> ', k, '</p><a href="mailto:anna', k, '%40muster.ch?subject=x">Mail</a> <span data-cfemail="422302206c212a"></span><footer>Musterweg ', k, '</footer></body></html>')"""


@_query(
    """select c_custkey as uid, 'anna' || c_custkey || '@muster.ch' || chr(10) || 'T' || chr(10) || 'RechtxWir' || chr(10) || 'Hallo Welt ' || c_custkey || chr(10) || 'Mail a@b.ch' || chr(10) || 'Musterweg ' || c_custkey as said,
    'https://www.muster.ch/impressum' as imprint, 'https://www.muster.ch/team' as about, 'Name: Muster ' || c_custkey || ' AG | Address: 3000' as organisation from customer"""
)
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.spread(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_custkey").cast("string").alias("k"))).withColumn("html", F.expr(_PAGE)).withColumn("base", F.lit("https://www.muster.ch/"))
    rows = rows.select("uid", html.page_parts("html", "base").alias("x"))
    return rows.select("uid", "x.said", F.array_join("x.imprint", " ").alias("imprint"), F.array_join("x.about", " ").alias("about"), "x.organisation")


@_query("select c_custkey as uid, 'strasse fin ' || lower(c_name) as folded, 'info@xn--mller-kva.ch' as address, '<p>' || c_name || ' &amp; &lt;b&gt;</p><p>x<br><a href=\"https://s.ch/?c=1\">https://s.ch/?c=1</a></p>' as html from customer")
def q_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").withColumn("said", F.concat(F.lit(" Straße \t \ufb01N  "), "c_name", F.lit(" "))).withColumn("mail", F.lit(" Info@Müller.ch "))
    written = F.concat("c_name", F.lit(" & <b>\n\nx\nhttps://s.ch/?c=1"))
    return rows.select(F.col("c_custkey").alias("uid"), text.normalised("said").alias("folded"), text.address_key("mail").alias("address"), mail.as_html(written).alias("html"))


@_query(
    """select c_custkey as uid, case c_nationkey % 3 when 0 then 'Frau' when 1 then null else 'Frau' end as word, case c_nationkey % 3 when 0 then 'page' when 1 then null else 'page-surname' end as origin,
    c_nationkey % 7 < 5 as unsafe from customer"""
)
def q_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    said = F.when(nation % 3 == 0, "Fragen an Frau Anna Muster.").when(nation % 3 == 1, "Heute führt Anna Muster die Firma von Herr Muster.").otherwise("Ihre Frau Muster")
    host = F.element_at(F.array(*map(F.lit, ("127.0.0.1", "localhost", "10.1.2.3", "192.168.0.1", "[::1]", "muster.ch", "8.8.8.8"))), (nation % 7 + 1).cast("int"))
    rows = _table(spark, sf_dir, "customer").withColumns({"given": F.array(F.lit("Anna")), "surname": F.lit("Muster"), "said": said, "role": F.lit(None).cast("string"), "unsafe": files.unsafe_address(host)})
    return rows.withColumn("s", mail.stated_salutation("given", "surname", "said", "role")).select(F.col("c_custkey").alias("uid"), "s.word", "s.origin", "unsafe")


@_query(
    """select c_custkey as uid, case when c_nationkey % 2 = 0 then 'anna muster:' || case when c_nationkey % 4 = 0 then 'anna@muster.ch:false' else 'a@else.ch:true' end else '' end as people,
    case c_nationkey % 3 when 0 then 'own' when 1 then 'offsite' else 'inbox' end as choice from customer"""
)
def q_checked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    page = F.when(nation % 2 == 0, "anna muster, leiterin, anna@muster.ch, a@else.ch logo@2x.png").otherwise("niemand hier")
    person = F.struct(F.lit("anna muster").alias("name"), F.lit("leiterin").alias("role"), F.when(nation % 4 == 0, "anna@muster.ch").otherwise("a@else.ch").alias("email"))
    ghost = F.struct(F.lit("urs probe").alias("name"), F.lit("chef").alias("role"), F.lit("logo@2x.png").alias("email"))
    found = decisions.checked_people(F.array(person, ghost), page, F.lit("muster ag"), F.lit("muster.ch"))
    none = F.lit(None).cast("string")
    choice = decisions.contact_choice(F.when(nation % 3 == 0, "own"), none, F.when(nation % 3 == 1, "offsite"), none, none, F.lit("inbox"), F.lit("lead"))
    told = F.transform(found, lambda p: F.concat(p["name"], F.lit(":"), p["email"], F.lit(":"), p["offsite"].cast("string")))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.array_join(told, " ").alias("people"), choice.alias("choice"))


@_query("select o_custkey as uid, kind, min(o_orderkey) as pos from (select *, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 end as kind from orders) x where kind is not null group by 1, 2")
def q_first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2)
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("url"), kind.alias("kind"))
    return candidates.first_of_kind(rows, ["uid"]).select("uid", "kind", F.col("url").cast("long").alias("pos"))


@_query("select c_custkey as uid, c_nationkey % 2 = 0 as shell, case when c_nationkey % 2 = 0 then 'muster.ch' end as inbox_domain, c_nationkey % 2 = 1 as blocked, 'Hans & Söhne' as short, 'hans-soehne.ch' as guessed from customer")
def q_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("c_nationkey") % 2 == 0
    page = F.when(even, '<div id="root"></div>').otherwise("<div>Text</div>")
    url = F.when(even, "https://www.muster.ch/x").otherwise("https://muster.jimdofree.com/")
    rows = _table(spark, sf_dir, "customer")
    guessed = F.get(F.filter(ids.guessed_domains(F.lit("Hans & Söhne")), lambda d: d.contains("-")), F.lit(0))
    return rows.select(F.col("c_custkey").alias("uid"), text.needs_javascript(page, F.lit("kurz")).alias("shell"), urls.inbox_domain(url).alias("inbox_domain"), urls.is_blocked(url, ["muster.jimdofree.com"]).alias("blocked"), text.without_legal_form(F.lit("Hans & Söhne AG in Liquidation")).alias("short"), guessed.alias("guessed"))


@_query(
    _with(("contacts", "drafts"))
    + """, c as (select * from (select uid, id, row_number() over (partition by uid order by id desc) as k from contacts) x where k = 1), d as (select * from (select *, row_number() over (partition by uid order by id desc) as k from drafts) x where k = 1)
    select c.uid, case when d.id is null then 'none' when frame_version <> 'f1' then 'old frame' when problems is null then 'unchecked' when problems <> '' then 'failed' when d.id % 3 = 0 then 'other contact' when d.id % 4 = 1 then 'other link' when d.id % 4 = 2 then 'fails now' end as why from c left join d on d.uid = c.uid"""
)
def q_draft_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, at = relations(spark, sf_dir), F.col("id")
    newest = ledger.latest(t["contacts"]).select("uid", at.alias("_newest"))
    rows = t["drafts"].join(newest, "uid", "left").withColumns({"contact_id": F.when(at % 3 == 0, -1).otherwise(F.col("_newest")), "link": F.when(at % 4 == 1, "old").otherwise("new"), "expected_link": F.lit("new"), "fails": at % 4 == 2})
    return contacts.draft_staleness(rows, t["contacts"], "f1")


@_query(_with(("contacts",)) + "select distinct uid from contacts where lower(trim(email)) = 'info@site9.example.com' or uid % 100 = 3")
def q_companies_offering(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = F.when(F.col("uid") % 100 == 3, F.array(F.struct(F.lit("a@b.ch").alias("email"), F.lit("seen").alias("kind")), F.struct(F.lit(" INFO@site9.example.com").alias("email"), F.lit("generic").alias("kind"))))
    rows = relations(spark, sf_dir)["contacts"].withColumn("addresses", several)
    return contacts.companies_offering(contacts.with_addresses(rows), "info@site9.example.com")


@_query(
    _with(("seen", "results", "companies", "progress"))
    + """, u as (select uid from seen where run_id = 'r1' union select uid from results where run_id = 'r1')
    select c.uid, p.step from u join companies c on c.uid = u.uid left join (select uid, max(step) as step from progress where run_id = 'r1' group by uid) p on p.uid = u.uid"""
)
def q_run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.run_steps(relations(spark, sf_dir), "r1").select("uid", "step")


@_query(_with(("results",)) + "select run_id, uid, reason from results where uid = 7 and recommendation is null")
def q_row_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.row_of(relations(spark, sf_dir)["results"], uid=7, recommendation=None).select("run_id", "uid", "reason")


@_query(_with(("invites",)) + "select distinct person from invites where person is not null and uid % 5 = 1")
def q_names_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir)["invites"].withColumn("profile", F.when(F.col("uid") % 5 == 1, "https://www.linkedin.com/in/X/").otherwise("https://linkedin.com/in/y"))
    return contacts.names_of_codes(rows, contacts.codes_of_profile(rows, ids.profile_key(F.col("profile")), "linkedin.com/in/x"))


@_query(_with(("invites", "responses")) + "select count(*) as links, count(started_at) as started, count(completed_at) as completed from invites i left join responses r on r.uid = i.uid")
def q_link_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    return report.link_answers(t["invites"], t["responses"])


@_query(_with(("companies",)) + "select count(*) filter (where screen_reason is null) as kept, count(*) filter (where screen_reason is not null) as dropped from companies")
def q_screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.screen_counts(relations(spark, sf_dir)["companies"])


@_query(
    """select o_orderkey, case o_orderkey % 4 when 0 then '2026-03-07 09:30' when 1 then '2026-03-07 09:30' when 2 then '2026-03-07 00:00' end as at, case when o_orderkey % 2 = 0 then 'CHE1' else 'AB' end as tag,
    case o_orderkey % 3 when 0 then 'brave,bing' when 1 then 'bing' else '' end as silent, o_orderkey % 2 = 0 as there, 'https://o.example/c?a=1&to=a%40b.ch&subject=' || replace(o_orderpriority, ' ', '%20') || '&body=x%20y' as link from orders"""
)
def q_answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (key % len(xs) + 1).cast("int"))
    silent = report.unresponsive(pick('{"unresponsive_engines": [["Brave", "timeout"], ["bing", "x"]]}', '{"unresponsive_engines": ["Bing"]}', '{"results": []}'))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(report.moment(pick("2026-03-07 09:30:00", " 2026-03-07 09:30", "2026-03-07", "gestern")), "yyyy-MM-dd HH:mm").alias("at"), report.tag(pick("CHE1", " "), F.lit("ab ")).alias("tag"), F.array_join(silent, ",").alias("silent"),
        text.appears_in(pick("anna", " "), F.lit("hallo anna muster")).alias("there"), ids.outlook("https://o.example/c?a=1", F.lit("a@b.ch"), F.col("o_orderpriority"), F.lit("x y"))["link"].alias("link"),
    )
