"""Typed answers of a model: checked against a schema, asked for again only where that may help, and each with what made it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

TOLD = "key string, said string, error_kind string, error_text string, model string, prompt_tokens long, completion_tokens long, finish_reason string, seconds double, attempts int"
_KINDS = {StringType: str, BooleanType: bool, LongType: int, IntegerType: int, DoubleType: (int, float), FloatType: (int, float)}


def misfit(value: object, kind: DataType, nullable: bool = True, at: str = "answer") -> str | None:
    """What is wrong with a value of parsed JSON for a type, or None. A struct's fields that may not be null have to be there; others than its own are left alone."""
    if value is None:
        return None if nullable else f"{at} is missing"
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            return f"{at} is no object"
        return next((x for f in kind if (x := misfit(value.get(f.name), f.dataType, f.nullable, f"{at}.{f.name}"))), None)
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            return f"{at} is no list"
        return next((x for i, v in enumerate(value) if (x := misfit(v, kind.elementType, kind.containsNull, f"{at}[{i}]"))), None)
    wanted = _KINDS.get(type(kind))
    if wanted is None:
        return f"{at} has a type that answers can't have"
    return None if isinstance(value, wanted) and (wanted is bool or not isinstance(value, bool)) else f"{at} is no {kind.simpleString()}"


def typed_answers(rows: DataFrame, ask: Callable[[str, int], dict], schema: str, prompt: str, prompt_version: str, effort: str = "low", budget: int = 4096, attempts: int = 2, pause: float = 0.0) -> DataFrame:
    """key, answer (a struct of schema; null where there is none), error_kind, error_text, and what made it: model, prompt, prompt_version, reasoning_effort, prompt_tokens, completion_tokens, finish_reason, seconds and attempts.

    rows: key, prompt_text. ask gets a text and the number of the attempt, and gives status, text, finish_reason, model, prompt_tokens and completion_tokens, or raises. An answer that was cut off (truncated) and a status of the
    4xx kind but 408 and 429 (rejected) come back the same if asked again, so they aren't; what can't be read, doesn't fit the schema, or failed is, and after so many attempts is an error (unusable).
    """
    wanted = rows.sparkSession.createDataFrame([], schema).schema

    def one(text: str) -> tuple:
        last = ""
        for turn in range(1, attempts + 1):
            if turn > 1:
                time.sleep(pause)
            began = time.monotonic()
            try:
                said = ask(text, turn)
            except Exception as e:  # noqa: BLE001
                last = f"{type(e).__name__}: {e}"
                continue
            status, finish = said.get("status", 200), said.get("finish_reason") or ""
            made = (said.get("model"), said.get("prompt_tokens"), said.get("completion_tokens"), finish, time.monotonic() - began, turn)
            if status != 200:
                last = f"status {status}"
                if 400 <= status < 500 and status not in (408, 429):
                    return None, "rejected", last, *made
                continue
            try:
                value = json.loads(said.get("text") or "")
                wrong = misfit(value, wanted, False)
            except ValueError as e:
                value, wrong = None, f"no JSON: {e}"
            if not wrong:
                return json.dumps(value, ensure_ascii=False), None, None, *made
            if finish == "length":
                return None, "truncated", f"cut off at {budget} tokens", *made
            last = wrong
        return None, "unusable", f"no usable answer after {attempts} attempts: {last}"[:500], None, None, None, None, None, attempts

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TOLD.split(", ")]
        for batch in batches:
            told = pd.DataFrame([(k, *one(t)) for k, t in zip(batch["key"], batch["prompt_text"], strict=True)], columns=names)
            yield told.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    told = rows.select(F.col("key").cast("string"), "prompt_text").mapInPandas(work, TOLD)
    return told.select(
        "key", F.from_json("said", wanted).alias("answer"), "error_kind", "error_text", "model", F.lit(prompt).alias("prompt"), F.lit(prompt_version).alias("prompt_version"), F.lit(effort).alias("reasoning_effort"),
        "prompt_tokens", "completion_tokens", "finish_reason", "seconds", "attempts",
    )
