"""Redirects followed over recorded answers, each hop guarded, and questions to hosts asked with a gap between them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.files import unsafe_address

#: Redirects that are followed (the feature).
MOST_REDIRECTS = 5
ASKED = "url string, host string, value string, error_kind string, error_text string, asked_at double"


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved; those that would go above the root are dropped."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == ".", out).when(p == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(p))))
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.when(F.element_at(kept, -1) != "", "/").otherwise(F.when(F.size(kept) > 1, "").otherwise("/"))).otherwise("")
    return F.concat(F.array_join(kept, "/"), end)


def joined(base: Column, ref: Column) -> Column:
    """What a reference on a page leads to: absolute, or relative to the page's scheme, host, folder, path or address."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), ref)).when(ref == "", base)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref)).when(ref.startswith("?"), F.concat(root, path, ref)).when(ref.startswith("/"), F.concat(root, without_dots(own), rest)).otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def refused(url: Column) -> Column:
    """Why a url must not be asked: another scheme than http and https, no host, or a literal address that isn't public; null if it may."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = urls.host(url)
    return F.when(~scheme.isin("http", "https"), F.concat(F.lit("refused scheme '"), scheme, F.lit("'"))).when(host == "", "refused: no host in the URL").when(unsafe_address(host), F.concat(F.lit("refused "), host, F.lit(": not a public address")))


def followed(asked: DataFrame, answers: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """url, final_url, hops, status and error of each row of asked (url), by recorded answers (url, a row each, status, location).

    Every hop is guarded as the first was, before its answer is looked at. An answer of the 3xx kind leads on to its location; without one it is an error, as are answers from 400 on, urls without an answer, and more than most
    redirects. Each hop is one join, and rows that have ended spread over all tasks.
    """
    known = answers.select(F.col("url").alias("_key"), F.col("status").alias("_status"), F.col("location").alias("_location"))
    null = F.lit(None).cast("string")
    rows = asked.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(None).cast("int").alias("status"), null.alias("error"), F.lit(True).alias("_open"))
    for turn in range(most + 1):
        why = F.when(F.col("_open"), refused(F.col("final_url")))
        rows = rows.withColumns({"error": F.coalesce("error", why), "_open": F.col("_open") & why.isNull()})
        rows = rows.withColumn("_key", F.when(F.col("_open"), F.col("final_url")).otherwise(F.concat(F.lit(" "), "url"))).join(known, "_key", "left")
        moved = F.col("_open") & F.col("_status").between(300, 399) & F.col("_location").isNotNull() & (F.trim("_location") != "")
        over = moved & F.lit(turn == most)
        said = (
            F.when(~F.col("_open"), F.col("error")).when(F.col("_status").isNull(), "no answer is recorded").when(over, f"more than {most} redirects").when(moved, null)
            .when(F.col("_status").between(300, 399), F.concat(F.lit("HTTP "), F.col("_status"), F.lit(" without a location"))).when(F.col("_status") >= 400, F.concat(F.lit("HTTP "), F.col("_status")))
        )
        moved = F.coalesce(moved, F.lit(False))
        rows = rows.select(
            "url", F.when(moved, joined(F.col("final_url"), F.trim("_location"))).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + moved.cast("int")).alias("hops"),
            F.when(F.col("_open") & ~moved, F.col("_status")).otherwise(F.col("status")).alias("status"), said.alias("error"), moved.alias("_open"),
        )
    return rows.drop("_open")


def asked_politely(asked: DataFrame, ask: Callable[[str], str], gap: float = 1.0, delays: DataFrame | None = None) -> DataFrame:
    """url, host, value, error_kind, error_text and asked_at (seconds of the clock) of each url of asked: no host is asked again within gap seconds, or its own delay (delays: host, delay).

    A host's urls have one task, as only that knows when it was last asked; a task asks its hosts in turns, so that it waits only when all of them are waited for. A url that fails is a row with an error.
    """
    rows = asked.select("url", urls.host(F.col("url")).alias("host"))
    rows = rows.join(delays.select("host", F.col("delay").cast("double")), "host", "left") if delays is not None else rows.withColumn("delay", F.lit(None).cast("double"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("url"))).sortWithinPartitions("turn", "host")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for url, host, delay in zip(batch["url"], batch["host"], batch["delay"], strict=True):
                wait = last.get(host, float("-inf")) + (gap if pd.isna(delay) else delay) - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host], at = time.monotonic(), time.time()
                try:
                    out.append((url, host, ask(url), None, None, at))
                except Exception as e:  # noqa: BLE001
                    out.append((url, host, None, type(e).__name__, str(e)[:500], at))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ASKED.split(", ")])

    return rows.select("url", "host", "delay").mapInPandas(work, ASKED)
