"""Naive Bayes support vectors for text quality.

Features are indicators: which n-grams a text has, of bytes (1 to 3) and of word shapes (1 to 3). Each is scaled by the
log ratio of its smoothed counts in the two classes, the scaled vector is brought to length one, and a linear model with
hinge loss is fitted to it by dual coordinate descent. Scores of models fitted to the other half of the
sample give the logistic curve that turns a margin into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, words

BITS = 19
SCORES = "doc_id long, score double"
#: Shapes that a task remembers.
CACHE_SHAPES = 300_000
_UPPER, _LOWER, _DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")


class Shapes(dict):
    """Word to the number of its shape: runs of upper case, lower case and digits are one letter each."""

    def __missing__(self, word: bytes) -> int:
        shape = _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))
        self[word] = out = int.from_bytes(shape[:3] + shape[-3:], "big") * 0x9E3779B1 + len(shape[:8]) & 0x7FFFFFFF
        return out


_shapes = Shapes()


def _grams(codes: np.ndarray, salt: int) -> list[np.ndarray]:
    """Numbers of the 1-, 2- and 3-grams of codes, each hashed to BITS bits."""
    codes = codes.astype(np.uint64)
    out, key = [], np.zeros(len(codes), np.uint64)
    for n in range(min(3, len(codes))):
        key = (key[: len(codes) - n] * np.uint64(0x100000001B3)) ^ (codes[n:] + np.uint64(1))
        mixed = (key + np.uint64(salt + n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct features of a text, in no order. seen: scratch numbers, one for each feature.

    A word that repeats the one before it counts as a shape of its own.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.int32)
    if len(_shapes) > CACHE_SHAPES:
        _shapes.clear()
    shapes = np.fromiter(map(_shapes.__getitem__, found), np.int64, len(found))
    same = np.fromiter(map(bytes.__eq__, found[1:], found), bool, len(found) - 1)
    shapes[1:][same] = 1
    every = np.concatenate(_grams(np.frombuffer(b" ".join(found), np.uint8), 11) + _grams(shapes, 77))
    order = np.arange(len(every), dtype=np.int32)
    seen[every] = order
    return every[seen[every] == order]


class Model(NamedTuple):
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found].astype(np.float64)
        return float(r @ self.weights[found] / max(np.sqrt(r @ r), 1e-12) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, smooth: float = 1.0) -> Model:
    """Ratios, and weights by dual coordinate descent for hinge loss; both classes weigh the same. The curve is left at the identity."""
    width = 1 << BITS
    counts = [np.full(width, smooth) for _ in (0, 1)]
    for found, k in zip(rows, labels, strict=True):
        counts[int(k)][found] += 1  # a text's features are distinct
    sizes = [max(1, int((labels == k).sum())) for k in (0, 1)]
    ratios = (np.log(counts[1] / (sizes[1] + 2 * smooth)) - np.log(counts[0] / (sizes[0] + 2 * smooth))).astype(np.float32)
    size = np.array([max(np.sqrt((r := ratios[found].astype(np.float64)) @ r), 1e-12) for found in rows])
    y, limit = np.where(labels == 1, 1.0, -1.0), cost * len(labels) / 2 / np.array([sizes[int(k)] for k in labels])
    weights, bias, alpha, rng = np.zeros(width), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found = rows[i]
            xi = ratios[found].astype(np.float64) / size[i]  # made anew each time: vectors of all rows would be three times the sample
            slope = y[i] * (xi @ weights[found] + bias) - 1
            new = min(max(alpha[i] - slope / (xi @ xi + 1), 0.0), limit[i])
            if step := (new - alpha[i]) * y[i]:
                weights[found] += step * xi
                bias += step
                alpha[i] = new
    return Model(ratios, weights.astype(np.float32), bias, 1.0, 0.0)


def curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits weighted labels best, by Newton's method."""
    a, b, good, bad = 1.0, 0.0, weight[labels == 1].sum(), weight[labels == 0].sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - goal), weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * margins).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The numbers in each row of a column of bytes, where they lie in Arrow's memory: the driver holds them once."""
    out = []
    for chunk in column.chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4 if len(chunk) else []
        numbers = np.frombuffer(chunk.buffers()[2] or b"", np.int32)
        out += [numbers[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, folds: int = 5) -> Model:
    """A model for labels.quality, from at most per_class labelled texts of each class: those whose hashed doc_id is least.

    Labels whose crc32(doc_id as text) mod folds is 0 aren't looked at. Labels other than 0 and 1 and null doc_ids are left
    out; where a doc_id has both labels, 0 holds. The driver gets the ids below a hash that
    about per_class of each class are below, and the distinct features of the texts of the sample: at most 2 * per_class rows. If a class has no text, every score is the share of the other.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place, least = F.xxhash64("id"), per_class + 10 * math.sqrt(per_class) + 100
    low = reduce(or_, ((F.col("label") == k) & (place <= int((1 << 64) * min(1.0, least / n)) - (1 << 63) - 1) for k, n in shares.items()), F.lit(False))
    near = sorted((r["place"], r["id"], r["label"]) for r in known.select("id", "label", place.alias("place")).where(low).collect())
    chosen = [x for k in shares for x in [(i, label) for _, i, label in near if label == k][:per_class]]
    sample = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, label int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(1 << BITS, np.int32)
        for batch in batches:
            found = [features(t, seen).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "found"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sample, "id").select("id", F.col("label").cast("int"), "text")
    rows = chosen.mapInArrow(run, "id long, label int, found binary").orderBy("id").toArrow()
    found, y = views(rows.column("found")), np.array(rows.column("label"), np.int64)
    if len(set(y.tolist())) < 2:
        odds = 30.0 if not len(y) or y[0] else -30.0
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, odds)
    margins = np.zeros(len(y))
    for k in (0, 1):
        there = np.arange(len(y)) % 2 == k
        half = fit([f for f, t in zip(found, there, strict=True) if not t], y[~there])
        margins[there] = [half.margin(f) for f, t in zip(found, there, strict=True) if t]
    weight = np.array([shares[int(k)] / (y == k).sum() for k in y])
    slope, shift = curve(margins, y, weight)
    return fit(found, y)._replace(slope=slope, shift=shift)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of each row of docs (doc_id, text).

    With keep, all columns of the rows predicted as 1, instead. A null text counts as an empty one and has the score of a text without
    features. Rows that repeat are scored each for itself; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = np.empty(1 << BITS, np.int32), shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = np.array([m.score(features(t, seen)) for t in batch.column(at).to_pylist()])
            if keep:
                yield batch.filter(pa.array(scores >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
        _shapes.clear()

    if keep:
        return docs.mapInArrow(run, docs.schema)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORES)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
