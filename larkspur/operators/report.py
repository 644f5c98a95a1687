"""Response rates for each arm of the experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import _standing, never_left, reported_mails


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of the Wilson interval, 0 and 0 without trials."""
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (1 + z * z / n))))
    return bound(middle - spread), bound(middle + spread)


def rate_text(hits: Column, n: Column) -> Column:
    """A rate in percent with its interval, a dash without trials."""
    low, high = wilson(hits, n)
    return F.when(n == 0, "–").otherwise(F.format_string("%.1f %% (%.1f–%.1f)", 100 * hits / n, 100 * low, 100 * high))


def report(ledger: DataFrame, suppression: DataFrame, responses: DataFrame, keys: tuple[str, ...] = ("frame_version", "arm", "contact_kind"), days: int | None = 21) -> DataFrame:
    """sent, bounced, never, started, completed and delivered for each group of latest mails; null keys count as a dash.

    An answer counts if it came 0 to days whole days after the mail's day, both included (days None: whenever).
    """
    back = _standing(ledger, "bounced").withColumn("back", F.lit(True))
    never = suppression.select("uid").unionByName(ledger.where("status = 'never'").select("uid")).distinct().withColumn("refused", F.lit(True))
    rows = reported_mails(ledger).join(back, "id", "left").join(never, "uid", "left").join(responses, "uid", "left")
    after = lambda c: F.datediff(F.to_date(c), F.to_date("decided_at"))
    inside = lambda c: F.col(c).isNotNull() if days is None else after(c).between(0, days)
    sums = {"sent": F.lit(True), "bounced": F.col("back"), "never": F.col("refused"), "started": inside("started_at"), "completed": inside("completed_at")}
    out = rows.groupBy(*(F.coalesce(k, F.lit("-")).alias(k) for k in keys)).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in sums.items()))
    return out.withColumn("delivered", F.col("sent") - F.col("bounced"))


def with_intervals(groups: DataFrame) -> DataFrame:
    low, high = wilson(F.col("completed"), F.col("delivered"))
    return groups.withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


def unmatched(responses: DataFrame, ledger: DataFrame, invites: DataFrame) -> DataFrame:
    """Answers whose tag is neither a company that a mail left for nor a personal code."""
    mailed = ledger.where("status = 'sent'").join(never_left(ledger), "id", "left_anti").select(F.col("uid").cast("string").alias("tag"))
    known = mailed.unionByName(invites.select(F.col("code").alias("tag"))).distinct()
    return responses.select(F.col("uid").cast("string").alias("tag")).join(known, "tag", "left_anti")


def merged_responses(raw: DataFrame) -> DataFrame:
    """tag, started and completed, one row a tag. raw: tag, started, completed as they came.

    Empty tags are left out; a completion without a start counts as one; of rows of a tag the first start and last completion stay.
    """
    tagged = raw.withColumn("tag", F.upper(F.trim("tag"))).where("tag <> ''")
    return tagged.groupBy("tag").agg(F.min(F.coalesce("started", "completed")).alias("started"), F.max("completed").alias("completed"))


def sendable(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count_if(F.coalesce((F.col("recommendation") == "send") & F.col("error_kind").isNull(), F.lit(False))).alias("sendable"))


def needs_js_by_uid(results: DataFrame, run_id: str) -> DataFrame:
    """uid and how many pages needed scripts, of a run's companies that were measured."""
    return results.where((F.col("run_id") == run_id) & F.col("needs_js").isNotNull()).groupBy("uid").agg(F.max("needs_js").alias("needs_js"))


def search_counts(searches: DataFrame) -> DataFrame:
    """For each provider how often it was asked, and how often it found nothing."""
    return searches.groupBy("provider").agg(F.count("*").alias("asked"), F.count_if(F.col("n_results") == 0).alias("silent"))


def search_log(searches: DataFrame) -> DataFrame:
    """What was asked about each company, in order."""
    at = F.row_number().over(Window.partitionBy("uid").orderBy("asked_at", "id"))
    return searches.select("uid", at.alias("at"), "provider", "n_results")


def company_names(companies: DataFrame, results: DataFrame) -> DataFrame:
    """The names of companies with results, each once, in order."""
    return companies.join(results.select("uid").distinct(), "uid", "left_semi").select("name").distinct().orderBy("name")


def score_summary(outcomes: DataFrame) -> DataFrame:
    """For each run how many companies were scored, taken from before, dropped, or failed."""
    return outcomes.groupBy("run_id").agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("cached", "scored", "dropped", "failed")))


def earlier_contacts(contacts: DataFrame, invites: DataFrame) -> DataFrame:
    """uid, at and person of everything that was prepared for a company before: mails by id, then links by code."""
    mails = contacts.select("uid", F.lit(0).alias("kind"), F.col("id").cast("string").alias("at"), "person")
    return mails.unionByName(invites.select("uid", F.lit(1).alias("kind"), F.col("code").alias("at"), "person")).orderBy("uid", "kind", "at").drop("kind")


def known_anywhere(tables: list[DataFrame], uid: int) -> DataFrame:
    """known: whether any table has a row of a company; a row of each at most is looked for."""
    one = reduce(DataFrame.union, (t.where(F.col("uid") == uid).select("uid").limit(1) for t in tables))
    return one.agg((F.count("*") > 0).alias("known"))


def link_answers(invites: DataFrame, responses: DataFrame) -> DataFrame:
    """How many personal links there are, were begun, and were completed."""
    rows = invites.select("code", "uid").join(responses, "uid", "left")
    return rows.agg(F.count("*").alias("links"), F.count_if(F.col("started_at").isNotNull()).alias("started"), F.count_if(F.col("completed_at").isNotNull()).alias("completed"))


def screen_counts(companies: DataFrame) -> DataFrame:
    """How many companies a screen keeps and drops."""
    return companies.agg(F.count_if(F.col("screen_reason").isNull()).alias("kept"), F.count_if(F.col("screen_reason").isNotNull()).alias("dropped"))


def moment(text: Column) -> Column:
    """A time as a survey writes it, with or without seconds or a zone; null if it is none."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")))


def tag(uid: Column, code: Column) -> Column:
    """What an answer is filed under: the company's number if it has one, else the code in capitals."""
    return F.coalesce(F.nullif(F.trim(uid), F.lit("")), F.nullif(F.upper(F.trim(code)), F.lit("")))


def unresponsive(payload: Column) -> Column:
    """The names, in small letters, of services that a search reports as silent: as pairs of name and reason, or as bare names."""
    field = F.get_json_object(payload, "$.unresponsive_engines")
    pairs = F.transform(F.from_json(field, "array<array<string>>"), lambda p: F.get(p, F.lit(0)))
    bare = F.from_json(field, "array<string>")
    return F.array_distinct(F.transform(F.when(field.rlike(r"^\s*\[\s*\["), pairs).otherwise(F.coalesce(bare, F.array().cast("array<string>"))), F.lower))
