"""Toxicity: a bag of subwords averaged into a linear softmax.

A word's subwords are its runs of 3 to 6 bytes, with a blank at either end, A-Z in lower case. Each has a vector; a word's is the mean of its
subwords', a window's (8 words in a row) the mean of its words', and a softmax over two classes sits on that. Vectors and softmax are
trained together, so a misspelling that was never met shares the vectors of what it still has. A text is as toxic as its
worst window: after a first round over all windows, a text's worst windows under the model so far stand for it.

Every labelled text and every window of it is learnt from. Labelled texts are dealt out into units by hash; in each round a task goes
through a unit by stochastic gradients from the round's common model, and what the units changed is averaged, piece by piece, in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, remainder, staged, words

BITS, WIDTH, SPAN = 17, 8, 8
SIZES = (3, 4, 5, 6)
#: Bounds of windows(), which training no longer uses.
MOST_WINDOWS, MOST_BYTES = 128, 512
#: Bytes of labelled text in a unit while there are fewer units than the second number; with more text these grow to the third, and then there are more units.
LEAST_UNIT, UNITS, MOST_UNIT = 8 << 20, 32, 32 << 20
#: What a unit changed is handed on in so many pieces of subwords; margins are counted in steps of 1 / STEPS.
PIECES, STEPS, MOST_MARGIN = 64, 256, 256
CHANGED = "model int, piece int, unit int, change binary"
PACKED = "unit int, labels binary, halves binary, sizes binary, word binary, vocabulary binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def subwords(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the subwords of words that stand with one blank between them, and the number of the word of each."""
    codes = _LOWER[np.frombuffer(b" " + line + b" ", np.uint8)]
    blank = codes == 32
    before = np.cumsum(blank, dtype=np.int32)  # blanks up to and with each place
    wide, found, owner = codes.astype(np.uint64), [], []
    key = (wide[:-1] << np.uint64(8)) | wide[1:]
    for n in SIZES:
        if len(codes) < n:
            break
        key = (key[: len(codes) - n + 1] << np.uint64(8)) | wide[n - 1 :]
        inside = before[n - 2 : len(codes) - 1] == before[: len(codes) - n + 1]  # no blank but at its ends
        at = np.flatnonzero(inside)
        found.append((((key[at] + np.uint64(n)) * _ODD) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(before[at] - 1)
    return np.concatenate(found), np.concatenate(owner)


def once(found: list[bytes]) -> list[bytes]:
    """Words without those that repeat the one before."""
    return [x for x, y in zip(found, [None, *found], strict=False) if x != y]


def means(vocabulary: list[bytes], values: list[np.ndarray]) -> list[np.ndarray]:
    """The means of the subwords' values of each word, by each of values, some 256 KB of words at a time."""
    out, first, size = [[np.empty(0)] for _ in values], 0, 0
    for k, word in enumerate(vocabulary):
        size += len(word)
        if size >= 1 << 18 or k == len(vocabulary) - 1:
            found, owner = subwords(b" ".join(vocabulary[first : k + 1]))
            many = np.bincount(owner, minlength=k + 1 - first)
            for x, value in zip(out, values, strict=True):
                x.append(np.bincount(owner, value[found], k + 1 - first) / many)
            first, size = k + 1, 0
    return [np.concatenate(x) for x in out]


class Model(NamedTuple):
    """What a subword adds to a window's margin, what every window has, and the curve from a text's margin to a score."""

    value: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def words(self, line: bytes, n: int) -> np.ndarray:
        found, owner = subwords(line)
        return np.bincount(owner, self.value[found], n) / np.maximum(np.bincount(owner, minlength=n), 1)

    def margin(self, text: str | None) -> float:
        """The margin of a text's worst window; that of no words, if it has none."""
        found = once(words(text))
        if not found:
            return self.bias
        sums = np.concatenate([[0.0], np.cumsum(self.words(b" ".join(found), len(found)))])
        span = min(SPAN, len(found))
        return float((sums[span:] - sums[:-span]).max() / span + self.bias)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -500, 500))))


def windows(text: str | None) -> list[bytes]:
    """At most MOST_WINDOWS windows of a text, side by side, those of the least CRC-32. Training takes all windows (Unit) and doesn't call this."""
    found = once(words(text))
    lines = [b" ".join(found[i : i + SPAN]) for i in range(0, len(found), SPAN)]
    lines = [x for x in lines if len(x) <= MOST_BYTES]
    if len(lines) > MOST_WINDOWS:
        lines = sorted(lines, key=lambda x: (zlib.crc32(x), x))[:MOST_WINDOWS]
    return lines


class Bag:
    """Subwords of many windows, and how much each weighs in its window's mean."""

    def __init__(self, lines: list[bytes]) -> None:
        sizes = np.array([line.count(b" ") + 1 for line in lines])
        self.found, word = subwords(b" ".join(lines))
        window = np.repeat(np.arange(len(lines)), sizes)
        self.window = window[word]
        self.weight = 1 / (np.bincount(word, minlength=sizes.sum())[word] * sizes[self.window])
        self.n = len(lines)

    def means(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.window, self.weight * vectors[d][self.found], self.n) for d in range(len(vectors))], 1)


class State(NamedTuple):
    """What is trained: vectors and softmax, and for each number the sum of its squared gradients."""

    vectors: np.ndarray
    seen: np.ndarray
    soft: np.ndarray
    bias: np.ndarray
    seen_soft: np.ndarray
    seen_bias: np.ndarray

    @classmethod
    def first(cls, seed: int = 0) -> State:
        rng = np.random.default_rng(seed)
        vectors, soft = rng.normal(0, 0.01, (WIDTH, 1 << BITS)), rng.normal(0, 0.5, (WIDTH, 2))
        return cls(vectors.astype(np.float32), np.zeros((WIDTH, 1 << BITS), np.float32), soft, np.zeros(2), np.full(soft.shape, 1e-2), np.full(2, 1e-2))

    def model(self) -> Model:
        return Model((self.soft[:, 1] - self.soft[:, 0]) @ self.vectors.astype(np.float64), float(self.bias[1] - self.bias[0]))

    def pieces(self, then: State) -> Iterator[tuple[int, bytes]]:
        """What has changed since then: vectors and squares of a range of subwords, where any was met, and last the softmax."""
        wide = (1 << BITS) // PIECES
        for k in range(PIECES):
            at = slice(k * wide, (k + 1) * wide)
            change = np.stack([self.vectors[:, at] - then.vectors[:, at], self.seen[:, at] - then.seen[:, at]]).astype(np.float32)
            if change[1].any():
                yield k, change.tobytes()
        yield PIECES, np.concatenate([(x - y).ravel() for x, y in zip(self[2:], then[2:], strict=True)]).tobytes()

    def changed(self, pieces: Iterable[tuple[int, bytes]]) -> State:
        """With averaged changes added."""
        vectors, seen, rest = self.vectors.copy(), self.seen.copy(), list(self[2:])
        wide = (1 << BITS) // PIECES
        for k, change in pieces:
            if k < PIECES:
                x = np.frombuffer(change, np.float32).reshape(2, WIDTH, wide)
                vectors[:, k * wide : (k + 1) * wide] += x[0]
                seen[:, k * wide : (k + 1) * wide] += x[1]
            else:
                x = np.split(np.frombuffer(change, np.float64), np.cumsum([y.size for y in rest])[:-1])
                rest = [y + z.reshape(y.shape) for y, z in zip(rest, x, strict=True)]
        return State(vectors, seen, *rest)


def averaged(key: tuple, table: pa.Table) -> pa.Table:
    """The mean change of a piece: of each subword over the units that met it, of the softmax over all units."""
    model, piece = (k.as_py() for k in key)
    total, met = 0.0, 0
    for k in np.argsort(table.column("unit").to_numpy()).tolist():
        change = table.column("change")[k].as_py()
        if piece < PIECES:
            x = np.frombuffer(change, np.float32).reshape(2, WIDTH, -1).astype(np.float64)
            met = met + (x[1] > 0).any(0)
        else:
            x, met = np.frombuffer(change, np.float64), met + 1
        total = total + x
    mean = total / np.maximum(met, 1)
    return pa.table({"model": pa.array([model], pa.int32()), "piece": pa.array([piece], pa.int32()), "change": pa.array([(mean.astype(np.float32) if piece < PIECES else mean).tobytes()], pa.binary())})


class Unit:
    """All windows of some labelled texts, side by side, as numbers of words in a list of the different ones."""

    def __init__(self, labels: np.ndarray, halves: np.ndarray, sizes: np.ndarray, word: np.ndarray, vocabulary: list[bytes]) -> None:
        self.labels, self.halves, self.sizes, self.word, self.vocabulary = labels, halves, sizes, word, vocabulary
        many = -(-sizes // SPAN)
        self.owner = np.repeat(np.arange(len(sizes)), many)
        place = (np.arange(len(self.owner)) - np.repeat(np.cumsum(many) - many, many)) * SPAN
        self.start = (np.cumsum(sizes) - sizes)[self.owner] + place
        self.size = np.minimum(SPAN, sizes[self.owner] - place)

    @classmethod
    def of(cls, rows: Iterable[tuple[int, int, str | None]]) -> Unit:
        """Of rows of label, half and text."""
        number: dict[bytes, int] = {}
        labels, halves, flat = [], [], [np.empty(0, np.int32)]
        for label, half, text in rows:
            found = once(words(text))
            labels.append(label)
            halves.append(half)
            flat.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        return cls(np.array(labels, np.int8), np.array(halves, np.int8), np.array([len(x) for x in flat[1:]], np.int64), np.concatenate(flat), list(number))

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.labels, self.halves, self.sizes, self.word)] + [b" ".join(self.vocabulary)]

    @classmethod
    def unpacked(cls, labels: bytes, halves: bytes, sizes: bytes, word: bytes, vocabulary: bytes) -> Unit:
        return cls(*(np.frombuffer(x, t) for x, t in ((labels, np.int8), (halves, np.int8), (sizes, np.int64), (word, np.int32))), vocabulary.split(b" ") if vocabulary else [])

    def margins(self, models: list[Model]) -> list[np.ndarray]:
        """The margin of each window, by each model."""
        if not len(self.start):
            return [np.empty(0)] * len(models)
        return [np.add.reduceat(x[self.word], self.start) / self.size + m.bias for x, m in zip(means(self.vocabulary, [m.value for m in models]), models, strict=True)]

    def worst(self, models: list[Model]) -> list[np.ndarray]:
        """The margin of each text's worst window, by each model; that of no words, if it has none."""
        out = []
        for m, margins in zip(models, self.margins(models), strict=True):
            most = np.full(len(self.sizes), -np.inf)
            np.maximum.at(most, self.owner, margins)
            out.append(np.where(self.sizes > 0, most, m.bias))
        return out

    def use(self, model: Model, top: int) -> np.ndarray:
        """Whether a window stands for its text: the top worst of a clean text, and of a toxic one those that are likelier toxic, and the worst anyway."""
        margin = self.margins([model])[0]
        order = np.lexsort((-margin, self.owner))
        place = np.empty(len(margin), np.int64)
        place[order] = np.arange(len(margin)) - np.searchsorted(self.owner[order], self.owner[order], "left")
        return (place < top) & ((self.labels[self.owner] == 0) | (place == 0) | (margin > 0))

    def learn(self, states: dict[int, State], chosen: np.ndarray, batch: int = 512, rate: float = 1.0, ease: float = 0.02) -> dict[int, State]:
        """States by number after one pass over the chosen windows in their order: 0 learns from all of them, 1 and 2 from those of one half.

        Both classes weigh the same. Steps are scaled by the root of what squared gradients sum to, plus ease, which holds back subwords seldom met.
        With two classes the softmax's gradients are opposite, so one number for each subword, times the difference of the classes' columns, is its vector's gradient.
        """
        goal, half, slot, own = self.labels[self.owner].astype(np.int64), self.halves[self.owner], np.empty(1 << BITS, np.int32), {}
        for k, state in states.items():
            mine = np.ones(len(goal), bool) if k == 0 else half == k - 1
            many = [int((mine[chosen] & (goal[chosen] == c)).sum()) for c in (0, 1)]
            if sum(many):
                own[k] = State(*(np.array(x, np.float64) for x in state)), mine * np.array([0.5 / max(1, n) for n in many])[goal] * sum(many)
        for i in range(0, len(chosen), batch):
            at = chosen[i : i + batch]
            size = self.size[at]
            window, share = np.repeat(np.arange(len(at)), size), np.repeat(1 / size, size)
            different, word = np.unique(self.word[np.arange(len(window)) + np.repeat(self.start[at] - np.cumsum(size) + size, size)], return_inverse=True)
            found, owner = subwords(b" ".join([self.vocabulary[k] for k in different.tolist()]))
            met = np.flatnonzero(np.bincount(found, minlength=1 << BITS))
            slot[met] = np.arange(len(met))
            found, many = slot[found], np.bincount(owner, minlength=len(different))
            for (vectors, seen, soft, bias, seen_soft, seen_bias), heavy in own.values():
                weigh = heavy[at]
                n = np.count_nonzero(weigh)
                if not n:
                    continue
                near, apart = vectors[:, met], soft[:, 1] - soft[:, 0]
                value = np.bincount(owner, (apart @ near)[found], len(different)) / many
                margin = np.bincount(window, share * value[word], len(at)) + bias[1] - bias[0]
                p = weigh * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - goal[at])
                slope = np.bincount(found, (np.bincount(word, share * p[window], len(different)) / many)[owner], len(met))
                g, h = near @ slope / n, p.sum() / n
                step = apart[:, None] * slope
                squares = seen[:, met] + step * step
                seen[:, met] = squares
                vectors[:, met] = near - rate * step / (np.sqrt(squares) + ease)
                seen_soft += (g * g)[:, None]
                seen_bias += h * h
                soft -= 0.1 * np.stack([-g, g], 1) / np.sqrt(seen_soft)
                bias -= 0.1 * np.array([-h, h]) / np.sqrt(seen_bias)
        return {k: state for k, (state, _) in own.items()}


def packed(texts: DataFrame, units: int) -> DataFrame:
    """Texts (key, id, label, text) dealt out into units by key, a row each."""
    half = F.pmod("key", F.lit(2)).cast("int").alias("half")
    dealt = texts.withColumn("unit", F.pmod("key", F.lit(units)).cast("int")).repartitionById(units, "unit").sortWithinPartitions("unit", "key", "id", "label", "text").select("unit", "label", half, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for number, several in groupby(rows, key=lambda r: r[0]):
            row = Unit.of(r[1:] for r in several).packed()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=[c.split()[0] for c in PACKED.split(", ")])

    return dealt.mapInArrow(run, PACKED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Unit]]:
    for batch in batches:
        for k in range(batch.num_rows):
            number, *row = (c[k].as_py() for c in batch.columns)
            yield number, Unit.unpacked(*row)


def fit(units: DataFrame, rounds: int = 8, top: int = 4, seed: int = 0) -> list[State]:
    """Three states trained on packed units: on all texts, on those of half 0 and on those of half 1.

    In the first round every window has its text's label; from then on a text is stood for by its top worst windows. A unit has one
    task a round. The driver gets the averaged changes, 8 MB for each state, whatever the number of texts.
    """
    spark = units.sparkSession
    states = [State.first(seed)] * 3
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(states)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            for number, unit in unpacked(batches):
                chosen = np.flatnonzero(unit.use(shared.value[0].model(), top)) if turn else np.arange(len(unit.owner))
                chosen = np.random.default_rng([seed, turn, number]).permutation(chosen)
                mine = {0, *(int(h) + 1 for h in np.unique(unit.halves))}
                for k, state in unit.learn({k: s for k, s in enumerate(shared.value) if k in mine}, chosen).items():
                    for piece, change in state.pieces(shared.value[k]):
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (k, piece, number)), pa.array([change], pa.binary())], names=[c.split()[0] for c in CHANGED.split(", ")])

        kept = staged(units.mapInArrow(run, CHANGED).groupBy("model", "piece").applyInArrow(averaged, "model int, piece int, change binary"), "changes")
        found = kept.toArrow().to_pylist()
        drop_staged(kept)
        states = [s.changed((r["piece"], r["change"]) for r in found if r["model"] == k) for k, s in enumerate(states)]
        shared.destroy()
    return states


def curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits weighted labels best, by Newton's method with halved steps; ridge keeps it from a step where margins part the labels."""
    total = weight.sum()
    middle = float((weight * margins).sum() / total)
    spread = float(np.sqrt((weight * (margins - middle) ** 2).sum() / total)) or 1.0
    x = (margins - middle) / spread

    def loss(v: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(labels == 1, -1, 1) * (v[0] * x + v[1]))).sum() / total + ridge / 2 * (v[0] - 1) ** 2 * 1e-1)

    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -30, 30)))
        g, h = weight * (p - labels) / total, weight * p * (1 - p) / total
        gradient = np.array([(g * x).sum() + ridge * 1e-1 * (v[0] - 1), g.sum()])
        step = np.linalg.solve(np.array([[(h * x * x).sum() + ridge * 1e-1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]]), gradient)
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(v[0] / spread), float(v[1] - v[0] * middle / spread)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Model:
    """A model for labels.toxic, from every window of every labelled text.

    Labels whose crc32(doc_id as text) mod folds is held aren't looked at, nor are labels other than 0 and 1 and null doc_ids; where a
    doc_id has both labels, 1 holds. The curve from margins to scores is fitted to the margins that the model of one half gives the
    texts of the other, counted in steps of 1 / STEPS. If a class has no text, every score is that of the other.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    mine = docs.where(F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held)).select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = staged(mine.join(known, "id").select(F.xxhash64("id", "text").alias("key"), "id", "label", "text"), "labelled")
    shares = {(r["half"], r["label"]): (r["n"], r["size"] or 0) for r in texts.groupBy(F.pmod("key", F.lit(2)).alias("half"), "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if len({k for _, k in shares}) < 2:
        drop_staged(texts)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 30.0 if any(k for _, k in shares) else -30.0)
    units = staged(packed(texts, dealt(sum(size for _, size in shares.values()))), "units")
    drop_staged(texts)
    whole, *halves = (s.model() for s in fit(units))
    judges = halves[::-1] if len(shares) == 4 else [whole, whole]  # of each half; a half that lacks a class judges nothing
    shared = docs.sparkSession.sparkContext.broadcast(judges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in unpacked(batches):
            margin = np.where(unit.halves == 0, *unit.worst(shared.value))
            cell = np.rint(np.clip(margin, -MOST_MARGIN, MOST_MARGIN) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unit.labels.astype(np.int32)), pa.array(cell)], names=["label", "cell"])

    cells = units.mapInArrow(run, "label int, cell long").groupBy("label", "cell").agg(F.count("*").alias("n")).toArrow().sort_by([("label", "ascending"), ("cell", "ascending")])
    label, cell, n = (cells.column(c).to_numpy() for c in ("label", "cell", "n"))
    slope, shift = curve(cell / STEPS, label, n.astype(np.float64))
    shared.destroy()
    drop_staged(units)
    return whole._replace(slope=slope, shift=shift)


def dealt(size: int) -> int:
    """How many units so many bytes of labelled text are dealt out into: one, or an even number, so that each has texts of one half."""
    n = max(min(size // LEAST_UNIT, UNITS), -(-size // MOST_UNIT))
    return n + n % 2 if n > 1 else 1


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of each row of docs (doc_id, text).

    A null text counts as an empty one and has the score of a text without words. Whole texts are scored, whatever their length; rows that repeat are
    scored each for itself, and an empty table gives no rows. The model is a megabyte, sent to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
