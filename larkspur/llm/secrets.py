"""Secret scans by an incremental blob ledger.

Every version of every path is named by the SHA-256 of its text, its blob. The ledger holds the (blob, rule,
version of the rule) that have been scanned and what was found in them; a run scans only what the ledger
lacks, one copy of each blob, and reports join findings back to every path that has, or had, the blob.
All of it is DataFrame operations: matches come from regexp_extract_all and their places from the lengths of
what split() leaves between them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged


class Rule(NamedTuple):
    """A match counts if its group has least characters or more; version rises with every change."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE
SEEN = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start long, end long"


class Ledger(NamedTuple):
    seen: DataFrame
    findings: DataFrame


def empty_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark.createDataFrame([], SEEN), spark.createDataFrame([], FINDINGS))


def save(ledger: Ledger, path: str) -> None:
    """Writes a ledger to a new folder."""
    ledger.seen.write.parquet(f"{path}/seen")
    ledger.findings.write.parquet(f"{path}/findings")


def load(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark.read.schema(SEEN).parquet(f"{path}/seen"), spark.read.schema(FINDINGS).parquet(f"{path}/findings"))


def blob() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _quick(rule: Rule) -> str:
    """A pattern that fits wherever a match of the rule counts: long runs can be asked for at once, as runs are matched to their ends."""
    return {"hex": f"[0-9a-f]{{{rule.least}}}", "access": f"AKIA[A-Z0-9]{{{rule.least - 4}}}"}.get(rule.kind, rule.pattern)


def _hits(rule: Rule) -> Column:
    """For each match in text: the length of what is between it and the one before, its own length, and whether it counts."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    hits = F.arrays_zip(
        F.transform(F.slice(F.split("text", rule.pattern, -1), 1, F.size(found)), F.length).alias("gap"),
        F.transform(found, F.length).alias("length"),
        F.transform(value, lambda v: F.length(v) >= rule.least).alias("counts"),
    )
    wanted = F.array_contains("kinds", rule.kind) & F.col("text").rlike(_quick(rule))
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.when(wanted, hits).alias("hits"))


def advance(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> Ledger:
    """The ledger after a scan of what it lacks. versions: path (long), text; a row for each version of a path, in any order.

    A null text counts as an empty one. Rows that repeat, and copies under other paths, are scanned once. A path may be null.
    """
    spark = versions.sparkSession
    known = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    place = F.coalesce("path", F.lit(-(1 << 63))).alias("place")
    blobs = versions.select(place, blob().alias("blob")).groupBy("blob").agg(F.min("place").alias("place"))
    ruled = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    done = ledger.seen.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    lacking = F.when(F.col("done").isNull(), ruled).otherwise(F.array_except(ruled, "done"))
    todo = blobs.join(done, "blob", "left").select("blob", "place", F.transform(lacking, lambda x: x["kind"]).alias("kinds")).where(F.size("kinds") > 0)
    todo = staged(todo, "unseen_blobs")
    texts = versions.select(place, F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    scanned = texts.join(todo, ["blob", "place"]).dropDuplicates(["blob", "place"]).select("blob", "text", "kinds")
    rows = scanned.select("blob", F.explode(F.filter(F.array(*(_hits(r) for r in rules)), lambda x: x["hits"].isNotNull())).alias("x"))
    rows = rows.select("blob", "x.kind", "x.version", F.posexplode("x.hits").alias("at", "hit"))
    order = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("hit.gap") + F.col("hit.length")).over(order).cast("long"))
    found = ends.where("hit.counts").select("blob", "kind", "version", (F.col("end") - F.col("hit.length")).alias("start"), "end")
    seen = todo.select("blob", F.explode("kinds").alias("kind")).join(F.broadcast(known), "kind").select("blob", "kind", "version")
    return Ledger(ledger.seen.unionByName(seen), ledger.findings.unionByName(staged(found, "findings")))


def spans_by_blob(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans (array of start, place of the kind among the rules, kind, end; in order) of blobs with findings of the rules' present versions."""
    known = ledger.findings.sparkSession.createDataFrame([(k, r.kind, r.version) for k, r in enumerate(rules)], "place int, kind string, version int")
    current = ledger.findings.join(F.broadcast(known), ["kind", "version"])
    return current.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("spans"))


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(versions: DataFrame, ledger: Ledger) -> DataFrame:
    """A row for each version: path, counts and spans as op2's contract has them, with n_more for the kinds beyond the base."""
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>"))
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = versions.select("path", blob().alias("blob")).join(spans_by_blob(ledger), "blob", "left").select("path", spans.alias("spans"))
    return rows.select("path", *(count(r.kind) for r in BASE), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_more"))


def redacted(docs: DataFrame, ledger: Ledger, mark: str = "<secret>") -> DataFrame:
    """docs with the spans found in their texts replaced by mark, spans that overlap by one; n_chars follows. Other rows stay as they are."""
    clean = F.expr(f"""aggregate(_larkspur_spans, named_struct('out', '', 'at', 0L),
        (acc, s) -> if(s.start >= acc.at,
            named_struct('out', concat(acc.out, substring(text, cast(acc.at as int) + 1, cast(s.start - acc.at as int)), '{mark}'), 'at', s.end),
            named_struct('out', acc.out, 'at', greatest(acc.at, s.end))),
        acc -> concat(acc.out, substring(text, cast(acc.at as int) + 1)))""")
    known = spans_by_blob(ledger).select(F.col("blob").alias("_larkspur_blob"), F.col("spans").alias("_larkspur_spans"))
    found = docs.withColumn("_larkspur_blob", blob()).join(known, "_larkspur_blob", "left")
    same = F.col("_larkspur_spans").isNull()
    out = found.withColumn("_larkspur_text", F.when(same, F.col("text")).otherwise(clean))
    changed = {"text": F.col("_larkspur_text"), "n_chars": F.when(same, F.col("n_chars")).otherwise(F.length("_larkspur_text").cast(docs.schema["n_chars"].dataType))}
    return out.withColumns(changed).select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for the report over documents."""
    kinds = []
    for place, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(f"""select doc_id, {place} as place, '{r.kind}' as kind, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: struct_pack(
            s := list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0), n := length(h[i]), v := length(v[i]))), lambda x: x.v >= {r.least})) as hit
        from (select doc_id, string_split_regex(t, '{pattern}') as p, regexp_extract_all(t, '{pattern}', 0) as h, regexp_extract_all(t, '{pattern}', {r.group}) as v from d)""")
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    told = "kind || ':' || hit.s::bigint || ':' || (hit.s + hit.n)::bigint, ',' order by hit.s, place"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({reduce(lambda a, b: f"{a} union all {b}", kinds)}),
    g as (select doc_id, {counts}, string_agg({told}) filter (where place < {len(BASE)}) as base, string_agg({told}) as spans, count(*) filter (where place >= {len(BASE)}) as n_more from f group by doc_id)
    select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_more, 0) as n_more from d left join g using (doc_id)"""
