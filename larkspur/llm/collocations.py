"""Phrase collocation mining: a count-min sketch says which n-grams may be frequent, and only those are counted exactly.

Each task of the first pass counts the n-grams of one to five words in a sketch of its own; the sketches' cells are added up, and what
stays is a bit for each cell that reaches the least count. A sketch never counts too little, so no frequent n-gram has a bit that is 0. The second
pass numbers and counts the n-grams whose bits are all 1, exactly, and an n-gram only where its first and last n - 1 words have passed as well. Scores
and subsumption are joins over what is frequent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LONGEST = 5
SIZES = tuple(range(1, LONGEST + 1))
DEPTH = 2
#: Cells of a row of the sketch, as powers of two: for small tables, and at most, as each task counts in a byte or two a cell and row.
LEAST_BITS, MOST_BITS = 16, 26
#: N-grams to a cell beyond which a sketch of all lengths would sift too little, so that longer ones have a sketch of their own.
FULL = 32
PIECE = 1 << 16
#: Bytes of text that are worked on at once, bytes that a task has at least, if there are more tasks than cores, and rows of counts that a task holds to add them up.
WINDOW, SHARE, HELD = 1 << 20, 1 << 28, 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 32
_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD[list(_STOPS)] = 10
_STOP = re.compile(rb"[.,;:!?\x0a-\x0d]")
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which hangs on all bits of x."""
    for shift, factor in ((30, _MIX[0]), (27, _MIX[1])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of an odd base and of its inverse, modulo 2^64; kept for the next window."""
    if base not in known or len(known[base][0]) < n:
        of = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
        known[base] = of(np.uint64(base)), of(np.uint64(pow(base, -1, 1 << 64)))
    powers, inverse = known[base]
    return powers[:n], inverse[:n]


class Words(NamedTuple):
    """The words of some texts: the texts' bytes, folded; where each begins and ends; its piece; its language's number; its hash."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    hash: np.ndarray

    def hashes(self, base: int) -> np.ndarray:
        return _hashes(self.codes, self.start, self.end, base)

    def numbers(self) -> np.ndarray:
        """The number of each word: equal for equal words and no others, as their bytes are compared."""
        size = self.end - self.start
        for base in _BASES:
            _, first, number = np.unique(self.hashes(base), return_index=True, return_inverse=True)
            like = first[number]
            if np.array_equal(size[like], size):
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                if np.array_equal(self.codes[np.repeat(self.start, size) + at], self.codes[np.repeat(self.start[like], size) + at]):
                    return number
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.codes[a:b].tobytes(), len(known)) for a, b in zip(self.start, self.end, strict=True)], np.int64)


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    powers, inverse = _powers(base, len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def read(texts: list[bytes], langs: list[int]) -> Words:
    """Words of texts. langs: the number of each text's language."""
    codes = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = (codes != 32) & (codes != 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(codes == 10)[start] if len(start) else np.empty(0, np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    lang = np.array(langs, np.int64)[np.searchsorted(ends, start, "right")]
    return Words(codes, start, end, piece, lang, _hashes(codes, start, end, _BASES[0]) if len(start) else np.empty(0, np.uint64))


def grams(words: Words, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n: n, which words begin an n-gram within a piece, and the n-grams' hashes, of which language and words are part."""
    at, key = np.arange(len(words.start)), mixed(words.hash + seeds[words.lang]) if len(words.start) else words.hash
    for n in range(1, LONGEST + 1):
        if n > 1:
            fits = at + n - 1 < len(words.piece)
            at, key = at[fits], key[fits]
            fits = words.piece[at] == words.piece[at + n - 1]
            at = at[fits]
            key = mixed(key[fits] * np.uint64(_MIX[1]) + words.hash[at + n - 1])
        yield n, at, key


def cells(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each n-gram in each row of a sketch of 2^bits cells a row."""
    return [(key >> np.uint64(64 - bits)).astype(np.int64), ((key * np.uint64(_MIX[0])) >> np.uint64(64 - bits)).astype(np.int64)]


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and their languages, window bytes or a little more at once. A longer text comes in parts, cut where a piece ends."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rest = (text or "").encode("utf-8", "replace")
            while rest:
                cut = len(rest)
                if cut > window and (stop := _STOP.search(rest, window)):
                    cut = stop.end()
                texts.append(rest[:cut])
                langs.append(lang)
                size, rest = size + cut, rest[cut:]
                if size >= window:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _read(texts: list[bytes], langs: list[str]) -> tuple[Words, list[str], np.ndarray]:
    """Words of texts, their languages, and what tells each language apart in hashes."""
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    seeds = np.array([int.from_bytes(x.encode()[-8:].rjust(8, b"\0"), "big") * 31 + len(x) & (1 << 64) - 1 for x in names], np.uint64)
    return read(texts, [number[x] for x in langs]), names, mixed(seeds)


def _present(rows: list[np.ndarray], key: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of each n-gram reach the least count."""
    there = np.ones(len(key), bool)
    for row, cell in zip(rows, cells(key, bits), strict=True):
        there &= (row[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
    return there


def sketch(docs: DataFrame, least: int, bits: int, window: int = WINDOW, sizes: tuple[int, ...] = SIZES, below: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each row of the sketch over docs (text, lang) of 2^bits cells, which cells reach least: 2^bits / 8 bytes a row on the driver.

    sizes: the lengths that are counted. below: such bits of shorter n-grams; longer ones are counted only if all their parts of the longest of those lengths have passed.

    A task counts in cells that stop at least, so that a byte or two hold one, and hands them on in pieces; pieces are added up where they meet, each in a table of its own.
    """
    kind = np.uint8 if least <= 255 else np.uint16 if least < 1 << 16 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(below)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.zeros((DEPTH, 1 << bits), kind), shared.value
        for texts, langs in _windows(batches, window):
            words, _, seeds = _read(texts, langs)
            alive = None
            for n, at, key in grams(words, seeds):
                if known is not None and n == sizes[0] - 1:
                    alive = np.zeros(len(words.start), bool)
                    alive[at[_present(known, key, bits)]] = True
                if n not in sizes:
                    continue
                if alive is not None:
                    there = alive[at]
                    for k in range(1, n - sizes[0] + 2):
                        there &= alive[at + k]
                    key = key[there]
                for row, cell in zip(table, cells(key, bits), strict=True):
                    cell.sort()
                    first = np.flatnonzero(np.diff(cell, prepend=-1))
                    times = np.diff(first, append=len(cell))
                    row[cell[first]] = np.minimum(row[cell[first]] + times, least).astype(kind)
        for r, row in enumerate(table):
            for k in range(0, 1 << bits, PIECE):
                part = row[k : k + PIECE]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r * (1 << MOST_BITS) // PIECE + k // PIECE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["piece", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(part.as_buffer(), kind)
                have = sums.get(piece)
                sums[piece] = np.minimum((more if have is None else have.astype(np.uint64) + more), least).astype(kind)
        for piece, have in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(have >= least).tobytes()], pa.binary())], names=["piece", "cells"])

    parts = docs.mapInArrow(count, "piece int, cells binary").repartition("piece").mapInArrow(add, "piece int, cells binary")
    bit = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    for row in parts.toLocalIterator():
        r, k = divmod(row["piece"], (1 << MOST_BITS) // PIECE)
        have = np.frombuffer(row["cells"], np.uint8)
        bit[r, k * PIECE // 8 : k * PIECE // 8 + len(have)] = have
    return list(bit)


def _strings(words: Words, at: np.ndarray, n: int) -> pa.Array:
    """The n-grams that begin at these words, space-joined."""
    size = words.end[at[:, None] + np.arange(n)] - words.start[at[:, None] + np.arange(n)]
    flat = size.ravel()
    total = flat + 1  # each word and a blank behind it, which takes the place of what follows it in the text
    begins = np.repeat(words.start[at[:, None] + np.arange(n)].ravel(), total)
    inner = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    data = words.codes[np.minimum(begins + inner, len(words.codes) - 1)]
    data[np.cumsum(total) - 1] = 32
    ends = np.cumsum(total.reshape(-1, n).sum(1))
    keep = np.ones(len(data), bool)
    keep[ends - 1] = False
    offsets = np.concatenate([[0], ends - np.arange(1, len(ends) + 1)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[keep]))


def count_survivors(docs: DataFrame, bit: list[np.ndarray] | dict[int, list[np.ndarray]], bits: int, window: int = WINDOW, held: int = HELD) -> DataFrame:
    """lang, size, phrase and f (its occurrences) of the n-grams of docs (text, lang) whose cells are all set in the sketch, or in that of their length; with size 0, the words of each lang.

    A task adds up what its windows give, and hands it on when that is over half of held rows, so that each n-gram is shuffled about once a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit if isinstance(bit, dict) else dict.fromkeys(SIZES, bit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in counted(batches):
            waiting.append(batch)
            n += batch.num_rows
            if n > held:
                waiting = added(waiting)
                n = sum(b.num_rows for b in waiting)
                if 2 * n > held:
                    yield from waiting
                    waiting, n = [], 0
        yield from added(waiting) if waiting else []

    def added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        keys = ["lang", "size", "phrase"]
        out = pa.Table.from_batches(batches).group_by(keys, use_threads=False).aggregate([("f", "sum")]).select([*keys, "f_sum"])
        return out.rename_columns([*keys, "f"]).to_batches(max_chunksize=1 << 16)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for texts, langs in _windows(batches, window):
            words, names, seeds = _read(texts, langs)
            alive, number, n_words = np.zeros(len(words.start), bool), None, words.numbers() if len(words.start) else None
            every = np.bincount(words.lang, minlength=len(names))
            yield _batch(names, pa.array([""] * len(names)), 0, every)
            for n, at, key in grams(words, seeds):
                if not len(at):
                    break
                there = _present(rows[n], key, bits)
                if n > 1:
                    there &= alive[at] & alive[at + 1]
                at = at[there]
                if not len(at):
                    break
                key = words.lang[at] * (n_words.max() + 1) + n_words[at] if n == 1 else number[at] * (n_words.max() + 1) + n_words[at + n - 1]
                _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                alive, number = np.zeros(len(words.start), bool), np.zeros(len(words.start), np.int64)
                alive[at], number[at] = True, inverse
                for k in range(0, len(first), 1 << 16):
                    some = at[first[k : k + (1 << 16)]]
                    yield _batch([names[x] for x in words.lang[some]], _strings(words, some, n), n, times[k : k + (1 << 16)])

    def _batch(langs: list[str], phrases: pa.Array, n: int, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.full(len(times), n, np.int32)), phrases, pa.array(times.astype(np.int64))], names=["lang", "size", "phrase", "f"])

    found = docs.mapInArrow(run, "lang string, size int, phrase string, f long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def scored(counts: DataFrame, most: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first most phrases of each lang. counts: lang, size, phrase, f, of all that is frequent, and with size 0 the words of each lang.

    A part of a frequent phrase is frequent, so l and r are always there. A candidate that a longer one contains as often as itself is contained as often by one that is a
    word longer, as counts only fall as words are added; so two parts of each candidate are all that is looked at. Products are decimals of 38 digits.
    """
    known = counts.where("size > 0").select("lang", "phrase", "f")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    split = candidates.withColumn("words", F.split("phrase", " ", -1))
    longer = split.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase")).distinct()
    alone = split.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.where("size = 0").select("lang", F.col("f").alias("n")), "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"({wide(1000)} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = 100, most: int = 2000, bits: int | None = None, window: int = WINDOW, full: int = FULL) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first most phrases of each lang of docs (text, lang), of those found least times.

    A null text counts as empty, a null lang as `und`; other columns are left out. Words without a piece, empty texts and empty tables
    give no rows; rows that repeat count each. Texts are worked on in windows cut between pieces, so only a piece has to fit a task's memory.

    The sketch has four cells a row for each n-gram that could be frequent, by the bytes of all texts, up to 2^MOST_BITS: 128 MB in each task that counts, and 16 MB of bits, which are broadcast. Where more
    than FULL n-grams would come to a cell, those of one and two words have a sketch, and longer ones another, which counts only those all of whose pairs have passed.
    What is found stays the same. A task reads SHARE bytes in each pass, as each hands on a sketch, and each n-gram that it has.
    """
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (4 * LONGEST * size // (6 * least)).bit_length()))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // SHARE))
    texts = texts.coalesce(tasks)
    if LONGEST * size // 6 <= full << bits:
        bit = dict.fromkeys(SIZES, sketch(texts, least, bits, window))
    else:
        short = sketch(texts, least, bits, window, SIZES[:2])
        bit = dict.fromkeys(SIZES[:2], short) | dict.fromkeys(SIZES[2:], sketch(texts, least, bits, window, SIZES[2:], short))
    counts = staged(count_survivors(texts, bit, bits, window).where((F.col("f") >= least) | (F.col("size") == 0)), "frequent")
    return scored(counts, most)


def oracle(least: int = 100, most: int = 2000) -> str:
    """DuckDB SQL for the rows of mine."""
    parts = " union all ".join(f"select lang, phrase, a, n, {k} as k, array_to_string(words[1:{k}], ' ') as first, array_to_string(words[{k + 1}:], ' ') as rest from alone where size > {k}" for k in range(1, LONGEST))
    sizes = " union all ".join(f"select lang, {n} as size, array_to_string(words[i:i + {n - 1}], ' ') as phrase from places where i + {n - 1} <= len(words)" for n in range(1, LONGEST + 1))
    return f"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    listed as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from pieces),
    places as (select lang, words, unnest(range(1, len(words) + 1)) as i from listed),
    totals as (select lang, sum(len(words))::bigint as n from listed group by lang),
    found as ({sizes}),
    known as (select lang, size, phrase, count(*) as f from found group by all having count(*) >= {least}),
    candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as words from known where size > 1),
    longer as (select distinct lang, a, unnest([array_to_string(words[1:size - 1], ' '), array_to_string(words[2:], ' ')]) as phrase from candidates where size > 2),
    alone as (select c.*, t.n from candidates c join totals t using (lang) where not exists (select 1 from longer x where x.lang = c.lang and x.phrase = c.phrase and x.a = c.a)),
    cuts as ({parts}),
    scores as (select c.lang, c.phrase, c.a, x.f as l, y.f as r, c.n, c.k, ((1000::hugeint * c.a * c.n) // (x.f::hugeint * y.f))::bigint as score
        from cuts c join known x on x.lang = c.lang and x.phrase = c.first join known y on y.lang = c.lang and y.phrase = c.rest),
    best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best)
    select * from ranked where rank <= {most}"""
