"""Token-id files, compressed by a Re-Pair grammar.

File format: a Parquet table with a row for each shard. A shard holds the documents that follow each other in
ascending doc_id order, as ``part`` (number of its range of doc_ids, in order), ``shard`` (number in the part),
``before`` (ids of the part in earlier shards), ``n_tokens``, ``doc_ids``, ``doc_tokens`` (ids of each document)
and four blobs of little-endian unsigned 32-bit integers: ``symbols`` (the compressed ids; those from
``base`` on are rules), ``rules`` (left and right symbol of rule base, base + 1, ...), ``rule_tokens``
(how many ids each rule expands to) and ``jumps`` (the number of ids before every JUMP-th symbol). With jumps
and rule_tokens a reader finds any run of ids without expanding what comes before it: see ``ids_between``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder

JUMP = 1024
#: What a range of documents should have at most, by Spark's estimate of their size, and what estimates of tables of unknown size exceed. Rows that share a doc_id fall apart by how their texts begin.
RANGE_BYTES, UNKNOWN_BYTES = 256 << 20, 1 << 52
SHARDS = "part int, shard int, before long, n_tokens long, base long, doc_ids array<long>, doc_tokens array<long>, symbols binary, rules binary, rule_tokens binary, jumps binary"
RANGES = "part int, before long, doc_id long, n_tokens long, ids_crc32 long"
_SHARD_FIELDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("symbols", "rules", "rule_tokens", "jumps"))])


def _frequent(left: np.ndarray, right: np.ndarray, least: int, most: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of pairs found least times or more, the most frequent first, of each place the pair's rank there (most: none), and whether the pair may be found so often.

    Pairs are counted by hash, each bucket for one pair that falls into it, so nothing is sorted; a pair that shares its
    bucket waits for a turn with other hashes. Where no bucket's own pair is found often enough, the rest are counted by sorting.
    """
    many = 1 << 21
    bucket = ((left * np.uint32(0x9E3779B1 + 2 * turn)) ^ (right * np.uint32(0x85EBCA6B + 6 * turn))) >> np.uint32(11)
    bucket = bucket.astype(np.intp)  # the type that counting and indexing work in
    possible = np.bincount(bucket, minlength=many)[bucket] >= least
    maybe = np.flatnonzero(possible)
    ranks = np.full(len(left), most, np.int32)
    bucket, keys = bucket[maybe], left[maybe].astype(np.uint64) << np.uint64(32) | right[maybe]
    owner = np.zeros(many, np.uint64)
    owner[bucket] = keys
    own = np.flatnonzero(owner[bucket] == keys)
    n = np.bincount(bucket[own], minlength=many)
    chosen = np.flatnonzero(n >= least)
    if len(chosen):
        chosen = chosen[np.argsort(-n[chosen], kind="stable")][:most]
        rank_of = np.full(many, most, np.int32)
        rank_of[chosen] = np.arange(len(chosen))
        ranks[maybe[own]] = rank_of[bucket[own]]
        return owner[chosen], ranks, possible
    kinds, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(n >= least)
    chosen = chosen[np.argsort(-n[chosen], kind="stable")][:most]
    rank_of = np.full(len(kinds), most, np.int32)
    rank_of[chosen] = np.arange(len(chosen))
    ranks[maybe] = rank_of[which]
    return kinds[chosen], ranks, possible


def compress(ids: np.ndarray, base: int, least: int = 32, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (n x 2) for ids (uint32, all below base).

    A round takes the most frequent pairs, up to most of them, and replaces each by a new symbol wherever no more frequent pair
    overlaps it; rounds go on until no pair is found least times. A place whose pair isn't found so often is looked at again only
    once a symbol beside it is replaced, as other pairs can but become fewer.
    """
    symbols, rules, turn = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)], 0
    places, n_rules = np.arange(max(len(symbols) - 1, 0)), 0
    while len(places) >= least:
        keys, found, possible = _frequent(symbols[places], symbols[places + 1], least, most, turn)
        if not len(keys):
            break
        rank = np.full(len(symbols) + 1, most, np.int32)  # of the pair at place k, at k + 1
        at = places[found < most]
        rank[at + 1] = found[found < most]
        over = at[rank[at + 1] == rank[at + 2]]  # a pair over itself (aaaa): every other place counts
        if len(over):
            first = np.flatnonzero(np.r_[True, np.diff(over) > 1])
            in_run = np.arange(len(over)) - np.repeat(first, np.diff(np.r_[first, len(over)]))
            rank[over[in_run % 2 == 0] + 2] = most
        mine = rank[at + 1]
        at = at[(mine < rank[at]) & (mine < rank[at + 2])]
        there = np.zeros(most, bool)
        there[rank[at + 1]] = True
        used = np.flatnonzero(there)
        symbols[at] = (base + n_rules - 1 + np.cumsum(there))[rank[at + 1]].astype(np.uint32)
        rules.append(np.c_[keys[used] >> np.uint64(32), keys[used] & np.uint64(0xFFFFFFFF)].astype(np.uint32))
        n_rules += len(used)
        again, keep = np.zeros(len(symbols), bool), np.ones(len(symbols), bool)
        again[places[possible]] = again[at] = again[np.maximum(at - 1, 0)] = True
        keep[at + 1] = False
        symbols, again = symbols[keep], again[keep]
        places, turn = np.flatnonzero(again[:-1]), turn + 1
    return symbols, np.concatenate(rules)


def rule_tokens(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to."""
    n = np.ones(len(rules), np.int64)
    while len(rules):
        new = sum(np.where(side < base, 1, n[np.where(side < base, 0, side.astype(np.int64) - base)]) for side in rules.T)
        if (new == n).all():
            break
        n = new
    return n


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: rules are expanded once, and copied to wherever they are used."""
    sizes, pool = rule_tokens(rules, base), np.arange(base, base + len(rules), dtype=np.uint32)
    while (at := pool >= base).any():
        width = at + 1
        out = np.repeat(pool, width)
        first = np.cumsum(width)[at] - 2
        out[first], out[first + 1] = rules[pool[at].astype(np.int64) - base].T
        pool = out
    at = symbols >= base
    used = symbols[at].astype(np.int64) - base
    width = np.ones(len(symbols), np.int64)
    width[at] = n = sizes[used]
    out = np.repeat(symbols, width)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.cumsum(width)[at] - n, n) + step] = pool[np.repeat((np.cumsum(sizes) - sizes)[used], n) + step]
    return out


def ids_between(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard, from the symbols that hold them alone."""
    symbols, rules, base = np.frombuffer(shard["symbols"], "<u4"), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), shard["base"]
    sizes, jumps = np.frombuffer(shard["rule_tokens"], "<u4"), np.frombuffer(shard["jumps"], "<u4")
    k = int(np.searchsorted(jumps, start, "right")) - 1
    end = int(np.searchsorted(jumps, stop, "left"))
    some = symbols[k * JUMP : end * JUMP]
    width = np.ones(len(some), np.int64)
    width[some >= base] = sizes[some[some >= base].astype(np.int64) - base]
    ends = int(jumps[k]) + np.cumsum(width)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    ids = expand(some[a:b], rules, base)
    skip = start - (int(ends[a - 1]) if a else int(jumps[k]))
    return ids[skip : skip + stop - start]


def shards(docs: DataFrame, tokenizer: str, end_id: int, base: int, shard_tokens: int) -> DataFrame:
    """Rows of the file format for documents that are sorted within ranges of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        docs_held, sizes_held, ids_held = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before
            ids = np.concatenate(ids_held)
            symbols, rules = compress(ids, base)
            sizes = rule_tokens(rules, base)
            width = np.ones(len(symbols), np.int64)
            width[symbols >= base] = sizes[symbols[symbols >= base].astype(np.int64) - base]
            row = {"part": part, "shard": shard, "before": before, "n_tokens": len(ids), "base": base, "doc_ids": [d for x in docs_held for d in x], "doc_tokens": [n for x in sizes_held for n in x]}
            row |= {k: x.astype("<u4").tobytes() for k, x in (("symbols", symbols), ("rules", rules), ("rule_tokens", sizes), ("jumps", (np.cumsum(width) - width)[::JUMP]))}
            shard, before = shard + 1, before + len(ids)
            for held in (docs_held, sizes_held, ids_held):
                held.clear()
            return pa.RecordBatch.from_pylist([row], _SHARD_FIELDS)

        size = 0
        for batch in batches:
            docs, (ids, ends) = batch.column(0).to_pylist(), encoder(tokenizer).ended(batch.column(1), end_id)
            sizes, at = np.diff(ends, prepend=0), 0
            while at < len(docs):  # up to where the shard is full
                first = int(ends[at - 1]) if at else 0
                stop = min(int(np.searchsorted(ends, first + shard_tokens - size)) + 1, len(docs))
                docs_held.append(docs[at:stop])
                sizes_held.append(sizes[at:stop].tolist())
                ids_held.append(ids[first : int(ends[stop - 1])])
                size += len(ids_held[-1])
                at = stop
                if size >= shard_tokens:
                    yield flush()
                    size = 0
        if docs_held:
            yield flush()

    return docs.mapInArrow(run, SHARDS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, base: int = 1 << 16, shard_tokens: int = 1 << 21) -> None:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order (nulls first, equal doc_ids by text) to path.

    A null text counts as empty and is the end id alone; an empty table gives a table without rows. base:
    above every id of the tokenizer. A document is never parted between shards; each shard is compressed for
    itself as soon as it has shard_tokens ids, so a task holds one shard and one batch of texts.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES if size < UNKNOWN_BYTES else 0)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange(parts, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    shards(ordered, tokenizer, end_id, base, shard_tokens).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files at path.

    The driver gets a number for each part, that is for each task that wrote, to sum up where parts begin.
    """
    table = spark.read.schema(SHARDS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                ids, at, out = memoryview(expand(symbols, rules, row["base"]).astype("<u4").tobytes()), 0, []
                for n in row["doc_tokens"]:
                    out.append((row["before"] + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at += n
                columns = [pa.array([row["part"]] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "before", "doc_id", "n_tokens", "ids_crc32"])

    at, begins = 0, []
    for row in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        begins.append((row["part"], at))
        at += row["n"]
    parts = F.broadcast(spark.createDataFrame(begins, "part int, begins long"))
    columns = "part", "before", "base", "doc_ids", "doc_tokens", "symbols", "rules"
    found = table.select(*columns).mapInArrow(run, RANGES).join(parts, "part")
    return found.select("doc_id", (F.col("begins") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
