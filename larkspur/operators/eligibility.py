"""Which companies may be drawn, in what order, and how the pool stands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import decided

Tables = Mapping[str, DataFrame]


class Setting(NamedTuple):
    """What a score must have been given for; equivalent models count alike, and a null criteria fits null only."""

    goal: str
    prompt: str
    models: Sequence[str]
    criteria: str | None
    least: int

    def fits(self, *, prompt: bool = True, model: bool = True, criteria: bool = True) -> Column:
        out = F.col("goal") == self.goal
        if model:
            out &= F.col("model").isin(*self.models)
        if prompt:
            out &= F.col("prompt") == self.prompt
        return out & F.col("criteria").eqNullSafe(F.lit(self.criteria)) if criteria else out


def best_scores(scores: DataFrame, setting: Setting) -> DataFrame:
    """uid and its best score among those that fit."""
    return scores.where(setting.fits()).groupBy("uid").agg(F.max("score").alias("score"))


def unscored(companies: DataFrame, scores: DataFrame, setting: Setting) -> DataFrame:
    """Kept companies without a score that fits: what a scoring run has left to do."""
    return companies.where("screen_reason is null").join(scores.where(setting.fits()).select("uid"), "uid", "left_anti")


def drawable(t: Tables, setting: Setting, run_id: str) -> DataFrame:
    """uid and score of companies that run_id may draw.

    Kept, scored high enough, not drawn by this run, without any ledger row and not suppressed; and never drawn, or failed in
    another run other than by interruption, without a result in any run that isn't an error.
    """
    drawn = t["seen"].groupBy("uid").agg(F.bool_or(F.col("run_id") == run_id).alias("here"))
    error = F.col("error_kind")
    ended = t["results"].groupBy("uid").agg(F.bool_or((error != "interrupted") & (F.col("run_id") != run_id)).alias("failed"), F.bool_or(error.isNull()).alias("finished"))
    rows = t["companies"].where("screen_reason is null").select("uid").join(best_scores(t["scores"], setting).where(F.col("score") >= setting.least), "uid")
    rows = rows.join(t["ledger"].select("uid"), "uid", "left_anti").join(t["suppression"].select("uid"), "uid", "left_anti").join(drawn, "uid", "left").join(ended, "uid", "left")
    again = F.coalesce("failed", F.lit(False)) & ~F.coalesce("finished", F.lit(False))
    return rows.where(F.col("here").isNull() | (~F.col("here") & again)).select("uid", "score")


def draw_batch(t: Tables, setting: Setting, run_id: str, batch_no: int, n: int, seed: str) -> DataFrame:
    """uid and score of the batch: the one on record if there is one, else the n best, ties in an order that seed shuffles."""
    on_record = t["seen"].where((F.col("run_id") == run_id) & (F.col("batch_no") == batch_no)).select("uid")
    shuffled = F.sha2(F.concat(F.col("uid").cast("string"), F.lit(seed)), 256)
    new = drawable(t, setting, run_id).orderBy(F.col("score").desc(), shuffled).limit(n)
    old = on_record.join(best_scores(t["scores"], setting), "uid", "left").select("uid", "score")
    none = on_record.agg((F.count("*") == 0).alias("none"))
    return old.unionByName(new.join(F.broadcast(none).where("none")).select("uid", "score"))


def standing_kinds(companies: DataFrame, scores: DataFrame, setting: Setting) -> DataFrame:
    """kind and n: each kept company once, under the closest kind of score that it has. One pass over the scores."""
    rungs = {"current": setting.fits(), "earlier_criteria": setting.fits(criteria=False), "other_prompt": setting.fits(criteria=False, prompt=False), "other_model": setting.fits(criteria=False, prompt=False, model=False)}
    flags = scores.groupBy("uid").agg(*(F.bool_or(c).alias(k) for k, c in rungs.items()))
    kind = F.coalesce(*(F.when(F.col(k), k) for k in rungs), F.lit("unscored"))
    return companies.where("screen_reason is null").join(flags, "uid", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def best_and_clear(companies: DataFrame, scores: DataFrame, setting: Setting) -> DataFrame:
    """best (highest score that fits) and clear (companies with one that is high enough), of kept companies."""
    rows = scores.where(setting.fits()).join(companies.where("screen_reason is null").select("uid"), "uid")
    return rows.agg(F.max("score").alias("best"), F.count_distinct(F.when(F.col("score") >= setting.least, F.col("uid"))).alias("clear"))


def standing(t: Tables, setting: Setting) -> DataFrame:
    """One row: pooled, kept, the kinds of standing_kinds, best, clear, drawable and the other prompts used (joined by commas)."""
    kinds = standing_kinds(t["companies"], t["scores"], setting).agg(
        F.sum("n").alias("kept"), *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("current", "earlier_criteria", "other_prompt", "other_model", "unscored"))
    )
    prompts = t["scores"].where(setting.fits(criteria=False, prompt=False) & (F.col("prompt") != setting.prompt)).agg(F.array_join(F.sort_array(F.collect_set("prompt")), ",").alias("other_prompts"))
    pooled = t["companies"].agg(F.count("*").alias("pooled"))
    free = drawable(t, setting, "").agg(F.count("*").alias("drawable"))
    return pooled.join(kinds).join(best_and_clear(t["companies"], t["scores"], setting)).join(free).join(prompts)


def _flags(t: Tables, setting: Setting) -> DataFrame:
    flag = lambda df, name: df.select("uid").distinct().withColumn(name, F.lit(True))
    waits = t["results"].where("recommendation = 'send'").select("uid").join(decided(t["ledger"]), "uid", "left_anti")
    rows = t["companies"].select("uid", "municipality", F.col("screen_reason").isNull().alias("is_kept"))
    for df, name in ((best_scores(t["scores"], setting), "has_score"), (drawable(t, setting, ""), "is_drawable"), (t["seen"], "is_drawn"), (t["ledger"].where("status = 'sent'"), "is_sent"), (waits, "is_undecided")):
        rows = rows.join(flag(df, name), "uid", "left")
    return rows


_COUNTS = {"kept": "is_kept", "scored": "is_kept and has_score", "drawable": "is_drawable", "drawn": "is_drawn", "sent": "is_sent", "undecided": "is_undecided"}


def status_by_group(t: Tables, setting: Setting) -> DataFrame:
    """For each municipality, how many companies are pooled, kept, scored, drawable, drawn, mailed and undecided."""
    return _flags(t, setting).groupBy("municipality").agg(F.count("*").alias("pooled"), *(F.count_if(F.expr(f"coalesce({c}, false)")).alias(k) for k, c in _COUNTS.items()))


def status_totals(t: Tables, setting: Setting) -> DataFrame:
    """status_by_group with a total under a null municipality, by one rollup."""
    return _flags(t, setting).rollup("municipality").agg(F.count("*").alias("pooled"), *(F.count_if(F.expr(f"coalesce({c}, false)")).alias(k) for k, c in _COUNTS.items()))


def batches(rows: DataFrame, group: str, size: int) -> DataFrame:
    """rows (group, uid) with batch_no: batches of at most size in a group, in the order of uid."""
    at = F.row_number().over(Window.partitionBy(group).orderBy("uid"))
    return rows.withColumn("batch_no", F.floor((at - 1) / size))
