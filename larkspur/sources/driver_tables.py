"""The campaign's relations, derived from the star-schema tables of a folder.

RELATIONS holds one SELECT for each; the text runs in Spark and in DuckDB alike, so queries and their SQL see the same rows. Scores come
from all orders; besides, an order's priority and status say which step of the campaign it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
_MODEL = "concat('m', cast(o_orderkey % 3 as varchar(9)))"
_RUN = "concat('r', cast(o_orderkey % 5 as varchar(9)))"
_BEFORE = "over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)"
RELATIONS: dict[str, str] = {
    "companies": """select c_custkey as uid, c_name as name, c_nationkey as municipality,
        case when c_mktsegment = 'BUILDING' then 'property only' when c_acctbal < -900 then 'in liquidation' end as screen_reason from customer""",
    "scores": f"""select o_custkey as uid, o_orderstatus as goal, o_orderpriority as prompt, {_MODEL} as model,
        case when o_orderkey % 7 = 0 then null when o_orderkey % 2 = 0 then 'c0' else 'c1' end as criteria, max(cast(o_orderkey % 11 as int)) as score
        from orders group by 1, 2, 3, 4, 5""",
    "seen": f"""select uid, run_id, batch_no, drawn_at from (select o_custkey as uid, {_RUN} as run_id, cast(o_orderkey % 3 + 1 as int) as batch_no, o_orderdate as drawn_at,
        row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') t where k = 1""",
    "results": f"""select run_id, uid, recommendation, error_kind, finished_at, needs_js, reason from (select {_RUN} as run_id, o_custkey as uid,
        case o_orderkey % 4 when 1 then 'send' when 2 then 'hold' when 3 then 'skip' end as recommendation,
        case when o_orderkey % 8 = 0 then 'interrupted' when o_orderkey % 4 = 0 then 'fetch' end as error_kind, o_orderdate as finished_at, concat('because of ', o_orderpriority) as reason,
        case when o_orderkey % 6 = 0 then null else cast(o_orderkey % 5 as int) end as needs_js,
        row_number() over (partition by o_orderkey % 5, o_custkey order by o_orderkey desc) as k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') t where k = 1""",
    "ledger": f"""select event_id as id, user_id as uid, case event_type when 'purchase' then 'sent' when 'view' then 'skipped' when 'click' then 'not_sent' when 'error' then 'bounced' else 'undone' end as status,
        ts as decided_at, case when user_id % 2 = 0 then 'voll' else 'kurz' end as arm, case event_id % 3 when 1 then 'seen' when 2 then 'generic' end as contact_kind, concat('f', cast(event_id % 2 as varchar(9))) as frame_version, case when event_type = 'purchase' then concat('Für Kunde ', cast(user_id as varchar(20))) end as subject,
        case when event_type in ('purchase', 'error') then concat('info@site', cast(user_id % 400 as varchar(20)), '.example.com') end as address, case when event_type = 'purchase' and event_id % 3 = 0 then event_id * 4 + 1 end as draft_id,
        case when event_type in ('click', 'error') then max(case when event_type = 'purchase' then event_id end) {_BEFORE}
        when event_type = 'signup' and event_id % 2 = 0 then max(case when event_type = 'error' then event_id end) {_BEFORE} end as reverses from events""",
    "suppression": "select c_custkey as uid from customer where c_acctbal < -850",
    "responses": """select user_id as uid, min(case when event_type = 'view' then ts end) as started_at, max(case when event_type = 'signup' then ts end) as completed_at
        from events where value > 60 group by user_id""",
    "contacts": """select o_orderkey as id, o_custkey as uid, case when o_orderkey % 3 = 0 then null else concat('Person ', cast(o_custkey as varchar(20))) end as person,
        concat('Info@Site', cast(o_custkey % 400 as varchar(20)), '.example.com') as email, case o_orderkey % 4 when 0 then 'third_party' when 1 then 'seen' when 2 then 'generic' else 'constructed' end as email_kind
        from orders where o_orderpriority = '2-HIGH'""",
    "drafts": """select o_orderkey as id, o_custkey as uid, o_orderdate as created_at, case o_orderkey % 5 when 0 then null when 1 then 'too long' else '' end as problems,
        concat('f', cast(o_orderkey % 2 as varchar(9))) as frame_version, case o_orderkey % 4 when 1 then first_contact when 3 then last_contact end as contact_id,
        case when o_orderkey % 7 = 0 or last_contact % 3 = 0 then 'Guten Tag' else concat('Guten Tag Person ', cast(o_custkey as varchar(20))) end as greeting,
        concat(case o_orderkey % 6 when 1 then 'https://umfrage.example' when 3 then 'https://anders.ch' else 'https://umfrage.ch' end, '/?c=', cast(o_custkey as varchar(20))) as link
        from (select *, min(case when o_orderpriority = '2-HIGH' then o_orderkey end) over (partition by o_custkey) as first_contact, max(case when o_orderpriority = '2-HIGH' then o_orderkey end) over (partition by o_custkey) as last_contact from orders) x
        where o_orderpriority = '3-MEDIUM'""",
    "searches": "select o_orderkey as id, o_custkey as uid, o_orderdate as asked_at, o_orderkey % 3 as n_results, o_orderstatus as provider from orders where o_orderpriority = '4-NOT SPECIFIED'",
    "sites": "select page_id + 1 as uid, url from pages",
    "profiles": "select s_suppkey as uid, concat('https://ch.linkedin.com/in/', replace(s_name, '#', '-'), case s_suppkey % 3 when 0 then '/' when 1 then '/?trk=x' else '#about' end) as profile from supplier",
    "progress": f"select {_RUN} as run_id, o_custkey as uid, o_orderstatus as step from orders where o_orderpriority = '5-LOW'",
    "runs": f"select {_RUN} as run_id, min(o_orderstatus) as goal, min(case when o_orderstatus = 'F' then o_orderpriority end) as criteria, min(o_orderdate) as started_at from orders group by 1",
    "requests": """select o_orderkey as id, o_custkey as uid, case o_orderkey % 9 when 0 then 'send' when 1 then 'address' when 2 then 'salutation' when 3 then 'skip' when 4 then 'never' when 5 then 'undo' when 6 then 'not_sent' when 7 then 'bounced' else 'dance' end as action,
        case when o_orderstatus = 'P' then 'nothing' when o_orderkey % 9 = 1 then concat('Info@Site', cast(o_custkey % 400 as varchar(20)), '.example.com') when o_orderkey % 9 = 2 then 'Frau' when o_orderkey % 9 = 3 then 'not now' end as argument,
        case when o_orderstatus = 'P' then 'x@y.example' else concat('Info@Site', cast(o_custkey % 400 as varchar(20)), '.example.com') end as to_address, o_orderpriority <> '5-LOW' as confirmed from orders""",
    "invites": """select concat('K', cast(conv_id as varchar(20))) as code, conv_id as uid, min(text) as person, max(turn) as n_notes from conversations where turn >= 0 group by conv_id""",
}


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's tables of sf_dir and the relations above, by name."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    out = dict(tables)
    for name, text in RELATIONS.items():
        used = {t: df for t, df in tables.items() if f"from {t}" in text}
        for t in used:
            text = text.replace(f"from {t}", f"from {{{t}}}")
        out[name] = spark.sql(text, **used)
    return out


def with_relations(*names: str) -> str:
    """The WITH clause that DuckDB needs for a query over some relations."""
    return "with " + ", ".join(f"{n} as ({RELATIONS[n]})" for n in names) + " "
