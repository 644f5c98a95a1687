"""Queries over tables that are stored and read again, registers read page by page, and domains by suffix rules; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import suffixes, urls
from ..operators import candidates, commits, ledger, overview, retention, review
from ..sources import paged, shared
from ..sources.driver_tables import relations
from ..streaming import scores as score_streams
from .catalogue import _ANSWER, _CURRENT, _FOLDS, RUN, _query, _with
from .more import _DECIDE, _GONE, _KEY, _OWN, _TABLES

_STORED = (*retention.ERASED, "results", "ledger", "pages", "suppression")
_KEYS = f"""select 'uid' as kind, cast(uid as varchar) as key from suppression union select 'address', lower(trim(address)) from ledger where status = 'sent' and address is not null and {_GONE}
    union select 'profile', 'linkedin.com/in/' || lower(rtrim(regexp_replace(replace(profile, 'https://ch.linkedin.com/in/', ''), '[?#].*$', ''), '/')) from profiles where {_GONE}"""


@_query(
    _with(_TABLES, _OWN)
    + " union all ".join(f"select '{n}' as table_name, count(*) as n from {n} where not {_GONE}" for n in retention.ERASED)
    + f""" union all select 'results', count(*) from results union all select 'results erased', count(*) from results where {_GONE} union all select 'ledger', count(*) from ledger
    union all select 'ledger with address', count(*) from ledger where address is not null and not {_GONE} union all select 'pages', count(*) from pages_ where domain not in (select domain from own)
    union all select 'suppression', count(*) from ({_KEYS}) k"""
)
def q_erased_in_one_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables are stored in one commit, companies erased from them in the next, and what the newest commit has is counted."""
    t, root = relations(spark, sf_dir), shared.shared_folder(spark, "campaign")
    commits.commit(spark, root, {n: t[n] for n in _STORED}, commits.state(spark, root))
    retention.erase_stored(spark, root, t["suppression"])
    now = commits.read(spark, root)
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    marked = [counted(now["results"].where("reason = 'erased'"), "results erased"), counted(now["ledger"].where("address is not null"), "ledger with address")]
    return reduce(DataFrame.unionByName, [*(counted(now[n], n) for n in _STORED), *marked])


@_query("select c_custkey as uid, c_name as name, n_name as street, case when c_acctbal >= 0 then c_acctbal end as worth from customer join nation on n_nationkey = c_nationkey")
def q_register_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register's answers of 250 rows, recorded from the customers, and read back by the data source."""
    size, root = 250, shared.shared_folder(spark, "register")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = ledger.numbered(rows, {"nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment")}, ["c_custkey"], "n")
    value = lambda c: F.when(c.isNotNull(), F.struct(c.cast("string").alias("value")))
    binding = F.struct(value(F.col("c_custkey")).alias("uid"), value(F.col("c_name")).alias("name"), value(F.col("n_name")).alias("street"), value(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("worth"))
    page = rows.groupBy(F.floor((F.col("n") - 1) / size).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(binding).alias("bindings")).alias("results"))).alias("value"))
    page.repartition("page").write.partitionBy("page").text(root)
    paged.register(spark)
    return spark.read.format("paged_register").schema("uid long, name string, street string, worth double").option("answers", root).option("size", size).load()


_HOSTS = r"hosts as (select distinct lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host from pages)"
_SUFFIX_RULES = """select 'com' as suffix, 0 as kind, false as private union select 'org', 0, false union select 'net', 0, false
    union select substring(host, 6), 1, true from hosts where host like 'blog.%' union select substring(host, 3), 1, false from hosts where host like 'm.%' union select host, 2, false from hosts where host like 'm.%.net' union select 'example.net', 0, true"""


@_query(
    f"""with {_HOSTS}, rules as ({_SUFFIX_RULES}),
    ends as (select host, i, array_to_string(string_split(host, '.')[i:], '.') as tail, len(string_split(host, '.')) as n from (select host, unnest(range(1, len(string_split(host, '.')) + 1)) as i from hosts) x),
    met as (select host, i + case kind when 2 then 1 when 1 then -1 else 0 end as begins, kind, private from ends join rules on suffix = tail where kind <> 1 or i > 1),
    best as (select * from met qualify row_number() over (partition by host order by kind <> 2, begins, private) = 1)
    select host, case when begins > 1 then array_to_string(string_split(host, '.')[begins - 1:], '.') else regexp_replace(host, '^www\\.', '') end as domain,
        case when begins > 1 then array_to_string(string_split(host, '.')[begins:], '.') end as suffix, coalesce(begins > 1 and private, false) as private from hosts left join best using (host)"""
)
def q_suffix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of all pages' hosts by rules that these hosts give: wildcards under hosts with a blog or a mobile page, the latter's .net ones excepted."""
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(urls.host(F.col("url")).alias("host")).distinct()
    rules = spark.sql(_SUFFIX_RULES.replace("from hosts", "from {hosts}"), hosts=hosts)
    return suffixes.resolved(hosts, rules)


@_query(_with(("scores",)) + """, first_ as (select uid, max(score) as score from scores where model = 'm0' group by uid)
    select uid, score, 'before' as origin from first_ union all select c_custkey, cast(c_custkey % 11 as int), 'stream' from customer where c_custkey not in (select uid from first_)""")
def q_streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as a stream of companies to score, of which some have scores; its batches come a second time, as after a crash that lost where it was."""
    root, t = shared.shared_folder(spark, "scores"), relations(spark, sf_dir)
    first = t["scores"].where("model = 'm0'").groupBy("uid").agg(F.max("score").alias("score")).withColumn("origin", F.lit("before"))
    commits.commit(spark, root, {"scores": first}, commits.state(spark, root))
    came = t["companies"].select("uid")
    came.repartition(2, "uid").write.parquet(f"{root}-in")
    for turn in ("one", "two"):
        stream = spark.readStream.schema(came.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}-in")
        score = lambda rows: rows.select("uid", (F.col("uid") % 11).cast("int").alias("score"), F.lit("stream").alias("origin"))
        score_streams.score_stream(stream, ["uid"], score, root, f"{root}-checkpoint-{turn}").awaitTermination()
    return commits.read(spark, root)["scores"]


@_query(
    _with(("companies", "ledger", "responses", "invites", "contacts"), _FOLDS)
    + f""", mails as (select uid, max_by(decided_at, id) as sent_at from ledger where status = 'sent' and id not in (select id from taken_back) group by uid), p as (select uid, person, row_number() over (partition by uid order by id desc) as k from contacts),
    l as (select 'link' as kind, code as tag, coalesce(name, cast(i.uid as varchar)) as company, person, r.started_at as at_, {_ANSWER} as answer from invites i left join responses r on r.uid = i.uid left join companies c on c.uid = i.uid
    union all select 'mail', cast(m.uid as varchar), coalesce(name, cast(m.uid as varchar)), person, m.sent_at, {_ANSWER} from mails m left join p on p.uid = m.uid and k = 1 left join companies c on c.uid = m.uid left join responses r on r.uid = m.uid)
    select row_number() over (order by cast(at_ as date) desc nulls last, at_ desc nulls last, kind, tag) as n, kind, tag, company, person, strftime(at_, '%Y-%m-%d %H:%M:%S') as at, answer from l"""
)
def q_log_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.log_in_order(relations(spark, sf_dir)).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@_query(
    _with(("results", "ledger"), _FOLDS + ", " + _CURRENT)
    + """, w as (select run_id, count(*) as waiting from results where recommendation = 'send' and uid not in (select uid from current_) group by run_id),
    r as (select run_id, count(*) as n, count(*) filter (where recommendation = 'send') as send, count(*) filter (where error_kind is not null) as failed, max(finished_at) as finished_at from results group by run_id)
    select r.*, coalesce(waiting, 0) as waiting, run_id = (select x.run_id from r x join w y on y.run_id = x.run_id order by x.finished_at desc, x.run_id desc limit 1) as first_waiting from r left join w using (run_id)"""
)
def q_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.home(relations(spark, sf_dir))


@_query(
    _DECIDE
    + """, seen_ as (select * from (select o_custkey as uid, concat('r', cast(o_orderkey % 5 as varchar(9))) as run_id, cast(o_orderkey % 3 + 1 as int) as batch_no, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') t where k = 1),
    results_ as (select * from (select concat('r', cast(o_orderkey % 5 as varchar(9))) as run_id, o_custkey as uid, case o_orderkey % 4 when 1 then 'send' when 2 then 'hold' when 3 then 'skip' else 'error' end as recommendation, concat('because of ', o_orderpriority) as reason,
        row_number() over (partition by o_orderkey % 5, o_custkey order by o_orderkey desc) as k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') t where k = 1 and run_id = 'r1'),
    site_ as (select page_id + 1 as uid, min(url) as site from pages group by 1)
    select row_number() over (order by case r.recommendation when 'send' then 0 when 'hold' then 1 when 'skip' then 2 else 3 end, s.batch_no asc nulls last, r.uid) as rank, r.uid, co.name, co.municipality, r.recommendation, s.batch_no, r.reason, si.site, c.person, c.email, x.status as decision, d.draft_id
    from results_ r left join seen_ s on s.uid = r.uid left join companies co on co.uid = r.uid left join site_ si on si.uid = r.uid left join c on c.uid = r.uid left join d on d.uid = r.uid left join current_ x on x.uid = r.uid"""
)
def q_wide_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relations(spark, sf_dir)
    states = review.card_states(t, "f1", _KEY(F.col("email")), "https://umfrage.ch/", F.col("municipality") % 5 != 2)
    return overview.wide_cards(t, RUN, states).select("rank", "uid", "name", "municipality", "recommendation", "batch_no", "reason", "site", "person", "email", "decision", "draft_id")


@_query(
    """with a as (select c_custkey as uid, case when c_acctbal < 0 then null when c_custkey % 7 = 0 then 99 else cast(c_custkey % 11 as int) end as first_, case when c_custkey % 7 = 0 and c_custkey % 5 > 0 then 5 end as second_ from customer)
    select uid, coalesce(case when first_ <= 10 then first_ end, second_) as score, case when first_ <= 10 then 1 when second_ is not null then 2 end as round from a"""
)
def q_scores_asked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all customers from a model that leaves some out, is out of range for others, and mends some when asked again."""
    asked, calls = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uid"), "c_acctbal"), []

    def score(rows: DataFrame) -> DataFrame:
        calls.append(1)
        odd = F.col("uid") % 7 == 0
        value = F.when(odd, 99).otherwise((F.col("uid") % 11).cast("int")) if len(calls) == 1 else F.when(odd & (F.col("uid") % 5 > 0), 5)
        said = rows.where("c_acctbal >= 0") if len(calls) == 1 else rows
        return said.select(F.col("uid").alias("pos"), "uid", value.alias("score"), F.lit(len(calls)).alias("round")).where("score is not null")

    good, missing = overview.asked_again(asked, score, candidates.validated_scores)
    return good.select("uid", "score", "round").unionByName(missing.select("uid", F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("round")))
