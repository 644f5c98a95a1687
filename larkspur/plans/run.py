"""The run loop: batches are drawn until there are enough results to send, and services stay behind a provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.eligibility import Setting, draw_batch
from ..operators.upsert import upsert
from ..sources import shared

ANSWER = "key string, value string, error_kind string, error_text string"


#: Errors that another try may mend.
PASSING = ("TimeoutError", "ConnectionError", "OSError")


def ask_each(rows: DataFrame, ask: Callable[[str], str], retries: int = 1, wait: float = 0.0, passing: tuple[str, ...] | None = None, gap: float = 0.0) -> DataFrame:
    """key, value, error_kind and error_text for each row (key, prompt) by an injected provider. A row that fails is a row with an error, never a failed batch.

    Errors of the kinds in passing (None: all) are tried again, retries times, after wait, twice wait, and so on; others at once are
    the answer. gap: seconds between two questions of a task.
    """

    def answer(prompt: str) -> tuple[str | None, str | None, str | None]:
        for turn in range(retries + 1):
            try:
                return ask(prompt), None, None
            except Exception as e:  # noqa: BLE001
                kind = type(e).__name__
                if turn == retries or passing is not None and kind not in passing:
                    return None, kind, str(e)[:500]
                time.sleep(wait * 2**turn)
        raise AssertionError

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for prompt in batch["prompt"]:
                said.append(answer(prompt))
                time.sleep(gap)
            yield pd.DataFrame({"key": batch["key"], "value": [s[0] for s in said], "error_kind": [s[1] for s in said], "error_text": [s[2] for s in said]})

    return rows.select(F.col("key").cast("string"), "prompt").mapInPandas(work, ANSWER)


def run_batches(tables: Mapping[str, DataFrame], setting: Setting, run_id: str, enrich: Callable[[DataFrame], DataFrame], target: int, size: int, most: int, seed: str, root: str, done: Callable[[int, DataFrame], None] | None = None) -> dict[str, DataFrame]:
    """The tables after batches 1, 2, ... of a run, until target results say send, the pool is dry or most batches are drawn.

    enrich: uids to results (uid, recommendation, error_kind, finished_at, needs_js). A batch on record is drawn as it was, and companies with a result in this run
    are not worked on again, so a run that broke off goes on where it was, be it with the tables it began from or with those it gave. What a batch draws and finds is written under root, a folder
    that driver and executors share, before the next is drawn; what is there whole is read, never written again, so no answer of a finished batch is asked for twice. A batch that broke off half-way
    is asked for anew. done gets each batch's number and results.
    """
    now, spark = dict(tables), tables["seen"].sparkSession

    def kept(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{root}/{run_id}/{name}"
        if not shared.there(spark, f"{path}/_SUCCESS"):
            shared.remove(spark, path)
            make().write.parquet(path)
        return spark.read.parquet(path)

    def added(name: str, rows: DataFrame) -> None:
        own = now[name].where(F.col("run_id") == run_id).select("uid")
        now[name] = now[name].unionByName(rows.join(own, "uid", "left_anti").select(rows.columns), allowMissingColumns=True)

    for batch_no in range(1, most + 1):
        batch = kept(f"batch-{batch_no}", partial(lambda k: draw_batch(now, setting, run_id, k, size, seed).select("uid"), batch_no))
        if batch.isEmpty():
            break
        added("seen", batch.select("uid", F.lit(run_id).alias("run_id"), F.lit(batch_no).alias("batch_no")))
        left = batch.join(now["results"].where(F.col("run_id") == run_id).select("uid"), "uid", "left_anti")
        results = kept(f"results-{batch_no}", partial(lambda rows: enrich(rows).withColumn("run_id", F.lit(run_id)), left))
        added("results", results)
        if done:
            done(batch_no, results)
        if now["results"].where((F.col("run_id") == run_id) & (F.col("recommendation") == "send")).count() >= target:
            break
    return now


def retried(results: DataFrame, run_id: str, enrich: Callable[[DataFrame], DataFrame], no_site: bool = False) -> DataFrame:
    """results with those of a run that ended in an error found again, and, if asked, those without a website; nothing is drawn."""
    failed = F.col("error_kind").isNotNull()
    if no_site:
        failed |= F.coalesce(F.col("reason").startswith("no website found"), F.lit(False))
    again = results.where((F.col("run_id") == run_id) & failed).select("uid")
    return upsert(results, enrich(again).withColumn("run_id", F.lit(run_id)), ["run_id", "uid"])


def prompt_data(companies: DataFrame, most: int = 300) -> DataFrame:
    """batch_no and the JSON that a scorer is asked about: number, name and the head of the purpose, at most so many characters of it, in the order of uid."""
    fields = F.struct("uid", "name", F.substring("purpose", 1, most).alias("purpose"))
    return companies.groupBy("batch_no").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("data"))
