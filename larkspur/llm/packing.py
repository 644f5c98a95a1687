"""Best-fit packing by minimum bin slack.

Bins are planned over the histogram of piece lengths, which has at most ``limit`` entries however many
documents there are: for one bin after the other, the longest length left goes in first, and a subset-sum
over the lengths still there, kept as bits of an integer, finds the combination that fills the rest best.
The combination is removed as often as its lengths last, which is what bin-by-bin choice would do. Executors
then look up the place of each piece from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
SLOTS = "length long, from_rank long, to_rank long, uses long, first_sequence long, first_offset long"


def cut(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of documents of sizes tokens: the document's place, the piece's number, start and length. What fits is whole; else the first piece takes what is left over."""
    many = np.maximum(-(-sizes // limit), 1)
    owner = np.repeat(np.arange(len(sizes)), many)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = (sizes - (many - 1) * limit)[owner]
    return owner, piece, np.where(piece > 0, first + (piece - 1) * limit, 0), np.where(piece > 0, limit, first)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its task that are as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            ids, ends = encoder(tokenizer).ended(batch.column(1), end_id)
            owner, piece, start, length = cut(np.diff(ends, prepend=0), limit)
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=limit + 1)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many)
            rank += seen[length]
            seen += many
            raw, begin = memoryview(ids.astype("<u4").tobytes()), 4 * (np.concatenate([[0], ends])[owner] + start)
            sums = [zlib.crc32(raw[b:e]) for b, e in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(owner), task), pa.int32()), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that they fill room best; larger lengths are tried first."""
    reach, taken, goal = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            taken.append((length, times, reach))
            reach |= (reach << (length * times)) & goal
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, times, before in reversed(taken):
        if not before >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def plan(histogram: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows of SLOTS, and the number of sequences.

    The pieces of a length with ranks from from_rank up to to_rank (exclusive) go, uses to a sequence, to the
    sequences from first_sequence on, from place first_offset on.
    """
    left, used, slots, sequence = {k: v for k, v in histogram.items() if v and k}, dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        others = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        chosen = fullest(limit - longest, others)
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in chosen.items()), 0
        for k in sorted(chosen, reverse=True):
            n = chosen[k]
            slots.append((k, used[k], used[k] + n * times, n, sequence, offset))
            used[k] += n * times
            offset += n * k
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequence += times
    return slots, sequence


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = 2048) -> DataFrame:
    """Places all documents in sequences of at most limit tokens.

    docs: doc_id, text; other columns are left out. A null text counts as empty and is the end id alone; an
    empty table gives no rows; rows that repeat are packed each for itself. Sequences are numbered from 0.
    What reaches the driver, and is broadcast back, is bounded by the number of lengths, that is by limit.
    """
    spark = docs.sparkSession
    cuts = staged(pieces(docs, tokenizer, end_id, limit), "pieces")
    held = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    slots, _ = plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cuts.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    places = F.broadcast(spark.createDataFrame(slots, SLOTS).withColumnRenamed("length", "slot_length"))
    at = ranked["rank"] - places["from_rank"]
    found = ranked.join(places, (ranked["length"] == places["slot_length"]) & (ranked["rank"] >= places["from_rank"]) & (ranked["rank"] < places["to_rank"]))
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("uses")) * F.col("length")).cast("long").alias("offset"),
    )
