"""Language-model scores by a weighted backoff automaton, and add-one unigram scores.

Tokens are the words of training, one token for all other words, and the end of a text. Word n-grams with
absolute discounting are interpolated with the next shorter ones; what single words give up goes to the unknown
word. Contexts become states of an automaton: an arc carries the log probability of a token after the context, and a token without
an arc takes the failure arc to the context without its first word, at the cost of its backoff weight. One traversal of a
text from left to right carries the state along and adds up log probabilities.

The vocabulary grows with the corpus, so the state without context is in two parts: arcs of frequent words go to every task,
those of all other words are met by key. Words and runs are told apart by 64-bit hashes, which tasks hand on as sorted arrays, one for each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, remainder, staged

#: A key and the places of its texts after row, each as often as it is found there; or, where row is -1 less that of a text, what the traversal says of it, as OWN.
MET = "row long, key long, at binary"
OWN = np.dtype([("doc_id", "<i8"), ("there", "<i8"), ("n_tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
SUMS = "row long, doc_id long, n_tokens long, known long, base double, score double"
#: Runs, or keys of weights, that a task holds before it hands them on.
TOGETHER = 2_000_000
#: Keys are dealt into buckets by their first eight bits; a task works on one bucket, a share of its table, at a time.
BUCKETS, _SHIFT = 1 << 8, np.uint64(56)
#: Arrays of 8 bytes a key or weight, 4 a count and 2 a text's place in its window, each a binary value: runs and their counts, weights, what a window of texts asks of a bucket (its texts' ids in a row of their own), and what it gets.
COUNTED = "bucket int, a binary, b binary, n binary"
WEIGHTS = "bucket int, key binary, base_weight binary, more binary"
ASKED = "bucket int, window long, key binary, n binary, place binary, ids binary"
ANSWERED = "window long, place binary, known binary, base binary, more binary, ids binary"
END = b""
#: Bits of a map of keys, which goes to every task, at most and at least, and of a block of it.
BITS, LEAST, _BLOCK = 1 << 28, 1 << 20, 1 << 18
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class Automaton(NamedTuple):
    """arcs: from state * len(numbers) + number of a word to log probability and next state; state 0 has no context."""

    numbers: dict
    arcs: dict[int, tuple[float, int]]
    backoff: list[float]
    failure: list[int]

    def traverse(self, found: list[bytes]) -> float:
        """The log10 probability of the words and the end, without what state 0 gives words that have no number."""
        return self.walk([self.numbers.get(w, -1) for w in (*found, END)])

    def walk(self, found: list[int]) -> float:
        """The same of the numbers of tokens, -1 where they have none."""
        arcs, backoff, failure, many, state, total = self.arcs, self.backoff, self.failure, len(self.numbers), 0, 0.0
        for number in found:
            if number < 0:
                while state:
                    total += backoff[state]
                    state = failure[state]
                continue
            while (arc := arcs.get(state * many + number)) is None:
                total += backoff[state]
                state = failure[state]
            total += arc[0]
            state = arc[1]
        return total


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """xxhash64 of two columns of longs, as Spark has it, over unsigned numbers."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.uint64(42)
    for x in (a, b):
        h = (h + _P5 + np.uint64(8)) ^ (turn(x * _P2, 31) * _P1)
        h = turn(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h = h ^ (h >> np.uint64(32))
    return h


#: Bytes in lower case, which of them part words, and masks of the first 0 to 8 bytes of a number.
_LOWER, _SPACE = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_LOWER[65:91] += 32
_SPACE[[32, *range(9, 14)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word from which on it is hashed by itself.
_LONG = 256
_END_KEY = mixed(np.zeros(1, np.uint64), np.zeros(1, np.uint64))[0]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place of the text and the key of each token of texts, null ones empty: words, A-Z in lower case, and after each text its end.

    The key of a word is a 64-bit hash of its length and of eight bytes after the other.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    codes = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    parts = np.ones(len(codes) + 1, bool)  # where no word goes on: blanks and, once words have begun, starts of texts
    parts[:-1] = blank = _SPACE[codes]
    first = ~blank
    first[1:] &= blank[:-1]
    borders = bounds[:-1][bounds[:-1] < len(codes)]
    first[borders] = ~blank[borders]
    last = ~blank & parts[1:]
    last[borders[borders > 0] - 1] = ~blank[borders[borders > 0] - 1]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - starts
    eights = np.ndarray(len(codes), "<u8", np.append(codes, np.zeros(8, np.uint8)).tobytes(), strides=(1,)) if len(codes) else np.empty(0, np.uint64)
    word = mixed(size.astype(np.uint64), eights[starts] & _MASK[np.minimum(size, 8)])
    more = np.flatnonzero((size > 8) & (size < _LONG))
    for k in range(8, _LONG, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        word[more] = mixed(word[more], eights[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)])
    for k in np.flatnonzero(size >= _LONG):
        word[k] = xxhash.xxh64_intdigest(codes[starts[k] : starts[k] + size[k]].tobytes(), 42)
    text = np.searchsorted(bounds[1:], starts, "right")
    many = np.bincount(text, minlength=len(texts))
    key = np.full(len(starts) + len(texts), _END_KEY)
    key[np.arange(len(starts)) + text] = word
    return np.repeat(np.arange(len(texts)), many + 1), key


def runs(of: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place of the text, the keys of the first and of the last n - 1 words, and the key of each run of n words within a text (words and its end), of its tokens' places and keys.

    The key of a run of n words is the hash of those two keys, so a run's parts are known from its row alone. A single word is its own part.
    """
    a = b = key
    for _ in range(1, n):
        a, b = key[:-1], key[1:]
        key = mixed(a, b)
    fits = of[: len(key)] == of[n - 1 :]
    return of[: len(key)][fits], a[fits], b[fits], key[fits]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it each distinct one starts."""
    order = np.argsort(key)
    near = key[order]
    return order, np.flatnonzero(np.append(True, near[1:] != near[:-1])[: len(near)])


def _buckets(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket that sorted keys have, with where it starts and ends among them."""
    bucket = (key >> _SHIFT).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[starts].tolist(), starts.tolist(), np.append(starts, len(key))[1:].tolist(), strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _whole(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """Some 32 bits for each of about n keys, a power of two from LEAST to BITS, those at the low bits of the keys set. What has no bit is not among the keys; a full map only lets more pass to where keys are compared."""
    size = min(max(1 << (32 * n).bit_length(), LEAST), BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(1).to_numpy()
            for block in np.unique(here := batch.column(0).to_numpy()).tolist():
                np.bitwise_or.at(blocks.setdefault(block, np.zeros(_BLOCK // 8, np.uint8)), bit[here == block] >> 3, np.uint8(1) << (bit[here == block] & 7).astype(np.uint8))
        for block, bits in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    low = F.col("key").bitwiseAND(F.lit(size - 1))
    dealt = keys.select(F.floor(low / _BLOCK).alias("block"), (low % _BLOCK).alias("bit")).repartition("block")
    out = np.zeros(size // 8, np.uint8)
    for r in dealt.mapInArrow(run, "block long, bits binary").toLocalIterator():
        out[r["block"] * (_BLOCK // 8) : (r["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def there(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    low = key & np.uint64(len(bits) * 8 - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def count_runs(docs: DataFrame, n: int, shorter: np.ndarray | None = None, least: int = 2) -> DataFrame:
    """a, b and n, staged: every run of n words that is found at least `least` times, by the keys of its first and its last n - 1 words (of a word: its own), and how often it is.

    shorter has the bits of the shorter runs found twice or more: a run that is found twice has parts that are, so none is missed.
    Tasks hand on arrays of the distinct runs they hold, a row for each of the buckets that keys are dealt into.
    """
    shared, size = docs.sparkSession.sparkContext.broadcast(shorter), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, waiting, n_held = shared.value, [], 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal n_held
            a, b, key = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            n_held = 0
            order, first = _distinct(key)
            at, times = order[first], np.diff(np.append(first, len(key))).astype("<u4")
            key, a, b = key[at], a[at], b[at]
            rows = [(k, a[i:j].tobytes(), b[i:j].tobytes() if size > 1 else b"", times[i:j].tobytes()) for k, i, j in _buckets(key)]
            yield from (_batch(rows[i : i + 256], COUNTED) for i in range(0, len(rows), 256))

        for batch in (b.slice(i, 100) for b in batches for i in range(0, len(b), 100)):
            _, a, b, key = runs(*tokens_of(batch.column(0)), size)
            if bits is not None:
                fits = there(bits, a) & there(bits, b)
                a, b, key = a[fits], b[fits], key[fits]
            waiting.append((a, b, key))
            n_held += len(key)
            if n_held > TOGETHER:
                yield from give()
        if waiting:
            yield from give()

    def merged(rows: pa.Table) -> pa.Table:
        a, times = _whole(rows["a"], "<u8"), _whole(rows["n"], "<u4")
        b = _whole(rows["b"], "<u8") if size > 1 else a
        order, first = _distinct(mixed(a, b) if size > 1 else a)
        total = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        at, total = order[first][total >= least], total[total >= least]
        return pa.table({"a": a[at].view(np.int64), "b": b[at].view(np.int64), "n": total})

    out = staged(docs.select("text").mapInArrow(run, COUNTED).groupBy("bucket").applyInArrow(merged, "a long, b long, n long"), "grams")
    shared.destroy()  # else each executor keeps its copy on disk
    return out


def packed(weights: DataFrame) -> DataFrame:
    """Rows of WEIGHTS: arrays of keys, of base_weight and of more, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def give() -> Iterator[pa.RecordBatch]:
            key, base, more = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, base, more = key[order], base[order], more[order]
            rows = [(k, key[i:j].tobytes(), base[i:j].tobytes(), more[i:j].tobytes()) for k, i, j in _buckets(key)]
            yield from (_batch(rows[i : i + 256], WEIGHTS) for i in range(0, len(rows), 256))

        for batch in batches:
            held.append([batch.column(0).to_numpy().view(np.uint64), *(batch.column(k).to_numpy() for k in (1, 2))])
            if sum(len(x[0]) for x in held) > TOGETHER:
                yield from give()
        if held:
            yield from give()

    return weights.select("key", "base_weight", "more").mapInArrow(run, WEIGHTS)


@lru_cache(1)
def _odd(n: int) -> np.ndarray:
    """An odd number for each of n places in a text."""
    return mixed(np.arange(n, dtype=np.uint64), np.full(n, 2, np.uint64)) | np.uint64(1)


def text_ids(of: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each of n texts, by its tokens and their order: texts that share it have the same score."""
    start = np.searchsorted(of, np.arange(n))
    many = np.diff(np.append(start, len(of)))
    return np.add.reduceat(key * _odd(1 << max(12, int(many.max()).bit_length()))[np.arange(len(of)) - np.repeat(start, many)], start) if n else np.empty(0, np.uint64)


def gained(docs: DataFrame, n: int, weights: DataFrame, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, known, base and more, staged, of each text: what its runs of n words that are wanted add up to, by the weights (key, base_weight, more; those of one key add up).

    A task gathers texts, and asks each bucket once for the distinct keys that they have; the bucket answers with sums for the texts, which meet again by window.
    Lengths of runs are asked for one after the other, so that the shuffle files of one are gone before the next.
    """
    size = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, waiting, ids, n_held, n_texts = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal window, n_held, n_texts
            key, place = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order, first = _distinct(key)
            key, place, ends = key[order[first]], place[order].astype("<u2"), np.append(first, len(key))
            times = np.diff(ends).astype("<u4")
            rows = [(window % BUCKETS, window, b"", b"", b"", np.concatenate(ids).tobytes())]
            rows += [(k, window, key[i:j].tobytes(), times[i:j].tobytes(), place[ends[i] : ends[j]].tobytes(), b"") for k, i, j in _buckets(key)]
            yield from (_batch(rows[i : i + 256], ASKED) for i in range(0, len(rows), 256))
            waiting.clear()
            ids.clear()
            window, n_held, n_texts = window + 1, 0, 0

        for batch in (b.slice(i, 100) for b in batches for i in range(0, len(b), 100)):
            of, token = tokens_of(batch.column(0))
            ids.append(text_ids(of, token, len(batch)))
            of, _, _, key = runs(of, token, size)
            fits = wanted(key)
            waiting.append((key[fits], of[fits] + n_texts))
            n_held, n_texts = n_held + len(waiting[-1][0]), n_texts + len(batch)
            if n_held > TOGETHER or n_texts > 60_000:
                yield from give()
        if waiting:
            yield from give()

    def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
        of, at = np.unique(_whole(known["key"], "<u8"), return_inverse=True)
        base, more = (np.append(np.bincount(at, _whole(known[c], "<f8"), len(of)), 0.0) for c in ("base_weight", "more"))
        rows = []
        for r in asked.to_pylist():
            if not r["key"]:
                rows.append((r["window"], b"", b"", b"", b"", r["ids"]))
                continue
            key, times = np.frombuffer(r["key"], "<u8"), np.frombuffer(r["n"], "<u4")
            found = np.searchsorted(of, key)
            found[np.append(of, 0)[found] != key] = len(of)
            place, text = np.unique(np.frombuffer(r["place"], "<u2"), return_inverse=True)
            found = np.repeat(found, times)
            sums = [np.bincount(text, x, len(place)) for x in (*((base[found] > 0, base[found]) if size == 1 else ()), more[found])]
            rows.append((r["window"], place.tobytes(), *([x.tobytes() for x in sums] if size == 1 else (b"", b"", sums[0].tobytes())), b""))
        return pa.Table.from_batches([_batch(rows, ANSWERED)])

    def added(rows: pa.Table) -> pa.Table:
        ids, place = _whole(rows["ids"], "<i8"), _whole(rows["place"], "<u2")
        known, base, more = (np.bincount(place, _whole(rows[c], "<f8"), len(ids)).astype(float) if size == 1 or c == "more" else np.zeros(len(ids)) for c in ("known", "base", "more"))
        return pa.table({"id": ids, "known": known.astype(np.int64), "base": base, "more": more})

    asked = docs.select("text").mapInArrow(run, ASKED)
    answers = asked.groupBy("bucket").cogroup(packed(weights).groupBy("bucket")).applyInArrow(answered, ANSWERED)
    sums = answers.groupBy("window").applyInArrow(added, "id long, known long, base double, more double")
    return staged(sums.groupBy("id").agg(*(F.max(c).alias(c) for c in ("known", "base", "more"))), "gained")


def gathered(first: int, key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of MET for keys at places, fewer than 2^16, after the row first: each distinct key once."""
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order].astype("<u2")
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    ends = np.append(starts, len(key))
    for i in range(0, len(starts), 50_000):
        here = ends[i : i + 50_001]
        n, bytes_ = len(here) - 1, place[here[0] : here[-1]].tobytes()
        at = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((here - here[0]) * 2).astype(np.int32).tobytes()), pa.py_buffer(bytes_)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, first)), pa.array(key[starts[i : i + n]].view(np.int64)), at], names=_names(MET))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SUMS from (row, at, base_weight, more): texts' own as they are, and of keys that met a weight what they add to each of their texts."""
    held: list[tuple[np.ndarray, ...]] = []

    def give() -> Iterator[pa.RecordBatch]:
        row, base, more = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        rows, at = np.unique(row, return_inverse=True)
        n = len(rows)
        sums = [np.bincount(at, base > 0, n).astype(np.int64), np.bincount(at, base, n), np.bincount(at, more, n)]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, sums)], names=_names(SUMS))

    for batch in batches:
        row, at = batch.column(0).to_numpy(), batch.column(1)
        ends = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1]
        data, own = np.frombuffer(at.buffers()[2], np.uint8), np.flatnonzero(row < 0)
        if len(own):
            x = np.frombuffer(b"".join(data[ends[k] : ends[k + 1]].tobytes() for k in own), OWN)
            doc_id = pa.array(x["doc_id"], mask=x["there"] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - row[own]), doc_id, *(pa.array(np.ascontiguousarray(x[n])) for n in OWN.names[2:])], names=_names(SUMS))
        base, more = (batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False) for k in (2, 3))
        fits = (row >= 0) & batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        if fits.any():
            many = np.diff(ends) // 2
            place = data[ends[0] : ends[-1]].view("<u2")[np.repeat(fits, many)]
            many = many[fits]
            held.append((np.repeat(row[fits], many) + place, np.repeat(base[fits], many), np.repeat(more[fits], many)))
            if sum(len(x[0]) for x in held) > TOGETHER // 2:
                yield from give()
    if held:
        yield from give()


def discounts(n1: int, n2: int, n3: int, n4: int, usual: float = 0.75) -> tuple[float, float, float]:
    """What words found once, twice, and more often give up, from how many words are found once to four times."""
    if not (n1 and n2 and n3):
        return usual, usual, usual
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * more / here, 0.1), k - 0.05) for k, here, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def compiled(numbers: dict[bytes, int], single: dict[bytes, int], levels: list[tuple[np.ndarray, np.ndarray]], tokens: int, less: tuple[float, float, float], discount: float) -> Automaton:
    """The automaton of counts. single: of the numbered words; levels: packed runs of 2, 3, ... words and their counts."""
    many = len(numbers)
    count = {(number,): single[w] for w, number in numbers.items()}
    probability = {run: max(c - less[min(c, 3) - 1], 0.0) / max(tokens, 1) for run, c in count.items()}
    state, backoff, failure, after = {(): 0}, [0.0], [0], {}
    for size, (keys, n) in enumerate(levels, 2):
        runs = [tuple(int(key) // many**k % many for k in range(size - 1, -1, -1)) for key in keys.tolist()]
        for run, c in zip(runs, n.tolist(), strict=True):
            after.setdefault(run[:-1], []).append((run[-1], c))
            count[run] = c
    for context in sorted(after, key=len):
        rest = 1 - sum(c - discount for _, c in after[context]) / count[context]
        state[context] = len(backoff)
        backoff.append(math.log10(max(rest, 1e-12)))
        suffix = context[1:]
        while suffix not in state:
            suffix = suffix[1:]
        failure.append(state[suffix])
        for number, c in after[context]:
            short, weight = (*context[1:], number), 0.0
            while short not in probability:  # the shorter context has no arc: its own failure arc gives the probability
                at = state.get(short[:-1])
                weight += backoff[at] if at is not None else 0.0
                short = short[1:]
            probability[(*context, number)] = (c - discount) / count[context] + rest * 10**weight * probability[short]
    return assembled(numbers, {run: math.log10(max(p, 1e-300)) for run, p in probability.items()}, {run: backoff[at] for run, at in state.items() if run})


def assembled(numbers: dict[bytes, int], probability: dict[tuple[int, ...], float], weight: dict[tuple[int, ...], float]) -> Automaton:
    """The automaton of log probabilities of runs of numbers, and of the backoff weights of contexts."""
    many, state, backoff, failure, arcs = len(numbers), {(): 0}, [0.0], [0], {}

    def longest(run: tuple[int, ...]) -> int:
        while run not in state:
            run = run[1:]
        return state[run]

    for context in sorted(weight, key=len):
        state[context] = len(backoff)
        backoff.append(weight[context])
        failure.append(longest(context[1:]))
    for run, p in probability.items():
        arcs[state[run[:-1]] * many + run[-1]] = (p, longest(run))
    return Automaton(numbers, arcs, backoff, failure)


def score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 3, contexts: int = 1 << 12, share: int = 1 << 16, head: int = 1 << 17, discount: float = 0.75) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Training has the rows whose crc32(doc_id as text) mod folds isn't held (a null doc_id counts as held out). A null text
    counts as empty: its only token is the end. Rows that repeat are scored, and counted, each for itself; an empty table
    gives no rows. Every word of training counts, however rare, and every run of up to order words that is found twice or more.
    head, contexts and share say only what goes to every task, whatever the corpus: words with at least a head-th of all
    training tokens, and arcs of words with at least a contexts-th in runs with at least a share-th. All others meet their weights in joins.

    The sum of a text's log probabilities is a sum over its runs: a word gives its own and its backoff weight, a longer run that
    has an arc gives what this arc has more than the failure arc and the next shorter arc, and its backoff weight. So arcs that are joined add to what the traversal says.
    """
    spark = docs.sparkSession
    out = F.coalesce(remainder("doc_id", folds) == held, F.lit(True))
    training = docs.where(~out)
    vocabulary = count_runs(training, 1, least=1).select(F.col("a").alias("key"), "n")
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), *(F.count_if(F.col("n") == k) for k in range(1, 5))).first()
    tokens, kinds = int(totals[0]), int(totals[1])
    less = discounts(*totals[2:])
    n = F.col("n")
    one = (n - F.when(n == 1, less[0]).when(n == 2, less[1]).otherwise(less[2])) / max(tokens, 1)
    zero, none = F.lit(0.0), spark.createDataFrame([], "key long, all long, rest double")
    level = vocabulary.select("key", "n", one.alias("p")).where("n > 1")
    grams, rests, bits = [], [], [bitmap(level, kinds - totals[2])]
    for size in range(2, order + 1):
        counted = count_runs(training, size, bits[-1])
        used = counted.groupBy(F.col("a").alias("key")).agg(F.sum(n - discount).alias("used"))
        rest = staged(used.join(level.select("key", F.col("n").alias("all")), "key").select("key", "all", F.greatest(1 - F.col("used") / F.col("all"), F.lit(1e-12)).alias("rest")), "rests")
        whole = counted.join(rest.withColumnRenamed("key", "a"), "a").select("a", "b", "n", "rest", ((n - discount) / F.col("all")).alias("own"))
        whole = whole.join(level.select(F.col("key").alias("b"), F.col("p").alias("short")), "b").withColumn("p", F.col("own") + F.col("rest") * F.col("short"))
        often_found = [F.when(n >= tokens / share, F.col(x)).alias(x) for x in ("a", "b")]
        level = staged(whole.select(F.xxhash64("a", "b").alias("key"), *often_found, "n", F.when(F.lit(size < order) | (n >= tokens / share), F.col("p")).alias("p"), (F.log10("p") - F.log10("rest") - F.log10("short")).alias("more")), "level")
        drop_staged(counted)
        grams.append(level)
        rests.append(rest)
        bits.append(bitmap(level, level.count()))
    rests.append(none)
    backoff = lambda of, rest: of.join(rest.select("key", F.log10("rest").alias("backoff")), "key", "left").withColumn("backoff", F.coalesce("backoff", zero))
    few = lambda of, rest: backoff(of, rest.join(F.broadcast(of.select("key")), "key", "left_semi")).toLocalIterator()
    end = int(_END_KEY.view(np.int64))
    frequent = {r["key"]: r for r in few(vocabulary.where((n >= tokens / head) | (F.col("key") == end)), rests[0])}
    often = {w: r["n"] for w, r in frequent.items()}
    often.setdefault(end, 0)
    numbers = {w: k for k, w in enumerate(sorted(w for w, m in often.items() if m >= tokens / contexts or w == end))}
    lost = lambda m: math.log10(max(m - less[min(m, 3) - 1], 0.0) / max(tokens, 1) or 1e-300)
    part, chance, weight = {w: (k,) for w, k in numbers.items() if w in frequent}, {(k,): lost(often[w]) for w, k in numbers.items()}, {}
    weight |= {(k,): frequent[w]["backoff"] for w, k in numbers.items() if w in frequent and frequent[w]["backoff"]}
    taken = set()
    for g, rest in zip(grams, rests[1:], strict=True):
        for r in few(g.where(n >= tokens / share).select("key", "a", "b", "p"), rest):
            if r["a"] in part and r["b"] in part:
                whole = part[r["a"]] + part[r["b"]][-1:]
                part[r["key"]], chance[whole] = whole, math.log10(r["p"])
                taken.add(r["key"])
                if r["backoff"]:
                    weight[whole] = r["backoff"]
    given = less[0] * totals[2] + less[1] * totals[3] + less[2] * (kinds - totals[2] - totals[3])
    unknown = given / tokens if tokens else 1.0
    automaton = assembled(numbers, chance, weight)
    here = np.sort(np.array(list(often), np.int64).view(np.uint64))
    arc = [(often[w], math.log10(often[w] + 1), 0.0 if w in numbers else lost(often[w]) + frequent[w]["backoff"], numbers.get(w, -1)) for w in here.view(np.int64).tolist()]
    arcs, sent = tuple(np.array(x) for x in zip(*arc, strict=True)), np.sort(np.array(list(taken), np.int64).view(np.uint64))
    model, floor = spark.sparkContext.broadcast((automaton, here, arcs)), math.log10(tokens + kinds + 1)
    among = lambda those, key: those[np.minimum(np.searchsorted(those, key), len(those) - 1)] == key if len(those) else np.zeros(len(key), bool)

    def unsent(fits: np.ndarray, key: np.ndarray) -> np.ndarray:
        fits[fits] = ~among(sent, key[fits])
        return fits

    rare = vocabulary.where(n < tokens / head)
    of_words = rare.select("key", F.log10(n + 1).alias("base_weight"), (F.log10(one) - math.log10(unknown)).alias("more"))
    backoffs = [r.select("key", zero.alias("base_weight"), F.log10("rest").alias("more")) for r in rests]
    sums = [gained(docs, 1, of_words.unionByName(backoffs[0]), lambda key: ~among(here, key))]
    for size, (g, b, met) in enumerate(zip(grams, backoffs[1:], bits[1:], strict=True), 2):
        shared = spark.sparkContext.broadcast(met)
        weights = g.select("key", zero.alias("base_weight"), "more").unionByName(b)
        sums.append(gained(docs, size, weights, lambda key, shared=shared: unsent(there(shared.value, key), key)))
        shared.destroy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (automaton, here, (often, base, gain, number)), failed = model.value, math.log10(unknown)
        for batch in (b.slice(i, 100) for b in batches for i in range(0, len(b), 100)):
            many, (of, key) = len(batch), tokens_of(batch.column(1))
            at = np.searchsorted(here, key)
            at[np.append(here, 0)[at] != key] = len(here)
            total = lambda x, rest, of=of, at=at, many=many: np.bincount(of, np.append(x, rest)[at], many)
            found, ends = np.append(number, -1)[at].tolist(), np.cumsum(np.bincount(of, minlength=many)).tolist()
            walked = [automaton.walk(found[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
            columns = [np.bincount(of, minlength=many), total(often > 0, 0).astype(np.int64), total(base, 0.0), total(gain, failed) + walked]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_ids(of, key, many).view(np.int64)), *map(pa.array, columns)], names=["doc_id", "id", "n_tokens", "known", "base", "score"])

    own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, id long, n_tokens long, known long, base double, score double")
    more = reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("known").alias("_known"), F.sum("base").alias("_base"), F.sum("more").alias("_more"))
    known, base = (F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("known", "base"))
    return own.join(more, "id", "left").select(
        "doc_id", out.alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (base - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("score") + F.coalesce("_more", zero)).alias("score"),
    )
