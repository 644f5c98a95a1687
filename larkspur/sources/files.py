"""Sources in files: register answers, responses, an older system's export, lists, notices and recorded service answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text

_VALUE = "struct<type: string, value: string>"
REGISTER = f"results struct<bindings: array<struct<uid: {_VALUE}, name: {_VALUE}, lf: {_VALUE}, desc: {_VALUE}, street: {_VALUE}, plz: {_VALUE}, city: {_VALUE}>>>"
SEARCH = "query string, provider string, results array<struct<url: string, title: string, snippet: string>>, unresponsive array<string>, error string"


def register_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies of SPARQL-JSON answers: what an answer lacks is null, and a purpose empty; with screen_reason."""
    rows = spark.read.schema(REGISTER).option("multiLine", True).json(path).select(F.explode("results.bindings").alias("b"))
    value = lambda k: F.col(f"b.{k}.value")
    purpose = F.coalesce(value("desc"), F.lit(""))
    return rows.select(
        ids.normalised_uid(value("uid")).alias("uid"), value("name").alias("name"), value("lf").alias("legal_form"), value("street").alias("street"), value("plz").alias("postal_code"), value("city").alias("city"),
        purpose.alias("purpose"), text.head_clause(purpose).alias("purpose_head"), text.screen_reason(value("name"), purpose).alias("screen_reason"),
    )


def responses_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """tag, started and completed of a survey's CSV, and the lines whose dates can't be read. The tag's column is tag or uid."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip().lower() for c in raw.columns))
    tag = next((c for c in ("tag", "uid") if c in raw.columns), None)
    if missing := [c for c in ("started_at", "completed_at") if c not in raw.columns] + ["tag"] * (tag is None):
        raise ValueError(f"columns missing: {', '.join(missing)}")
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    read = raw.select(F.col(tag).alias("tag"), said("started_at").alias("s"), said("completed_at").alias("c")).withColumns({"started": F.try_to_timestamp("s"), "completed": F.try_to_timestamp("c")})
    bad = (F.col("s").isNotNull() & F.col("started").isNull()) | (F.col("c").isNotNull() & F.col("completed").isNull())
    return read.where(~bad).select("tag", "started", "completed"), read.where(bad).select("tag", "s", "c")


def responses_json(bodies: DataFrame) -> DataFrame:
    """tag, started and completed of a survey service's answers (body: an array of objects). An element of the wrong type fails the whole batch."""
    rows = bodies.select(F.from_json("body", "array<struct<tag: string, started_at: string, completed_at: string>>", {"mode": "FAILFAST"}).alias("x")).select(F.explode("x").alias("x"))
    return rows.select("x.tag", F.to_timestamp("x.started_at").alias("started"), F.to_timestamp("x.completed_at").alias("completed"))


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """entry: the lines of a list, without comments and blanks, in lower case."""
    return spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("entry")).where("entry <> ''").distinct()


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """cells of the rows of a Markdown table, without its heading and rule."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|.*\|\s*$") & ~F.col("value").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select(cells.alias("cells")).where(F.col("cells")[0].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))


def earlier_decisions(companies: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of an older system that name a known company, and those that don't; an import goes on only if there are none."""
    read = rows.select(F.to_date(F.col("cells")[0]).alias("decided_at"), ids.normalised_uid(F.col("cells")[1]).alias("uid"), F.lower(F.col("cells")[4]).alias("status"), F.get("cells", F.lit(5)).alias("note"))
    known = companies.select("uid")
    return read.join(known, "uid", "left_semi"), read.join(known, "uid", "left_anti")


def notices_xml(spark: SparkSession, path: str) -> DataFrame:
    """publication, published and notice text of register notices, a file each."""
    raw = spark.read.text(path, wholetext=True)
    at = lambda p: F.xpath_string("value", F.lit(p))
    return raw.select(at("//publicationNumber").alias("number"), F.to_date(F.substring(at("//publicationDate"), 1, 10)).alias("published"), at("//publicationText").alias("text"))


def usable_notices(notices: DataFrame, uid: str, most: int = 500) -> DataFrame:
    """Notices that mention the company. More than most of them means that a service ignored its filter: that is an error."""
    total = notices.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") <= most, "the filter was ignored").alias("ok"))
    return notices.where(F.array_contains(_uids("text"), uid)).join(F.broadcast(total)).drop("ok")


def _uids(column: str) -> Column:
    return ids.find_uids(F.col(column))


def is_an_answer(results: Column, unresponsive: Column, baseline: list[str], error: Column) -> Column:
    """Whether a search's answer counts: no error, and some result, or some engine of the baseline that did answer."""
    silent = F.size(F.array_except(F.array(*map(F.lit, baseline)).cast("array<string>"), F.coalesce(unresponsive, F.array().cast("array<string>")))) == 0
    return error.isNull() & ((F.size(F.coalesce(results, F.array().cast("array<struct<url: string, title: string, snippet: string>>"))) > 0) | ~silent)


def settled_answers(searches: DataFrame, providers: list[str], baseline: list[str]) -> DataFrame:
    """The answer of the first provider, in order of preference, that didn't fail. Emptiness is an answer and isn't asked again."""
    order = reduce(lambda e, kp: e.when(F.col("provider") == kp[1], kp[0]), enumerate(providers), F.when(F.lit(False), 0))
    good = searches.where(is_an_answer(F.col("results"), F.col("unresponsive"), baseline, F.col("error")))
    return good.groupBy("query").agg(F.min_by(F.struct("provider", "results"), order).alias("x")).select("query", "x.*")


def unsafe_address(host: Column) -> Column:
    """Whether a host is this machine, or a literal address that is private, loopback, link-local, multicast or reserved."""
    part = lambda k: F.try_element_at(F.split(host, r"\."), F.lit(k)).try_cast("int")
    a, b = part(1), part(2)
    bad = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    six = F.lower(host).rlike(r"^\[(?:::1?|::ffff:.*|f[c-f][0-9a-f]{2}:.*)\]$")
    return (host == "localhost") | six | (host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & F.coalesce(bad, F.lit(True)))
