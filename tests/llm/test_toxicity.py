"""Subwords, means and margins against plain ones, and what the classifier makes of words it never met."""

import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import toxicity as tx

WORDS = "the of and river stone light under morning garden walks slowly house green window quiet table over small bridge reads".split()
BAD = "blockhead nitwit dimwit scoundrel".split()


def plain_subwords(word: bytes) -> list[bytes]:
    word = b" " + word.lower() + b" "
    return [word[i : i + n] for n in tx.SIZES for i in range(len(word) - n + 1)]


def test_subwords_of_each_word():
    words = [b"a", b"No", b"\xc3\xa9t\xc3\xa9", b"blockhead", b"x" * 30]
    found, owner = tx.subwords(b" ".join(words))
    for k, w in enumerate(words):
        mine = [int(x) for x in found[owner == k]]
        expected = []
        for g in plain_subwords(w):
            key = int.from_bytes(g, "big")
            expected.append(((key + len(g)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - tx.BITS)
        assert sorted(mine) == sorted(expected)


def test_margin_is_of_the_worst_window():
    rng = np.random.default_rng(1)
    model = tx.Model(rng.normal(size=1 << tx.BITS), 0.25)
    words = [f"w{k % 23}" for k in range(60)]
    value = [np.mean([model.value[n] for n in tx.subwords(w.encode())[0]]) for w in words]
    assert model.margin(" ".join(words)) == pytest.approx(max(np.mean(value[i : i + tx.SPAN]) for i in range(len(words) - tx.SPAN + 1)) + 0.25)
    assert model.margin("w1 \n w2") == pytest.approx(np.mean(value[1:3]) + 0.25)
    assert model.margin("w1 w1 w1 w2 w2") == model.margin("w1 w2")
    assert model.margin(None) == model.margin(" \t") == 0.25


def test_means_of_windows():
    vectors = np.random.default_rng(2).normal(size=(3, 1 << tx.BITS))
    lines = [b"one two", b"three", b"two two four five"]
    means = tx.Bag(lines).means(vectors)
    for k, line in enumerate(lines):
        words = [np.mean([vectors[:, n] for n in tx.subwords(w)[0]], 0) for w in line.split()]
        assert means[k] == pytest.approx(np.mean(words, 0))


def test_curve_of_parted_and_of_mixed_margins():
    rng = np.random.default_rng(3)
    labels = (rng.random(4000) < 0.3).astype(int)
    slope, shift = tx.curve(np.where(labels == 1, 40.0, -40.0) + rng.normal(size=4000), labels, np.ones(4000))
    assert 1 / (1 + np.exp(-(slope * 40 + shift))) > 0.95 and 1 / (1 + np.exp(-(slope * -40 + shift))) < 0.05
    margins = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margins - 1)))).astype(int)
    slope, shift = tx.curve(margins, labels, np.ones(4000))
    assert slope == pytest.approx(2, abs=0.3) and shift == pytest.approx(-1, abs=0.3)


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randint(5, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_misspellings(spark):
    rows = texts(900, 5)
    docs = spark.createDataFrame([(k, t, "x", 0.5) for k, t, _ in rows] + [(9000, None, "x", 0.5), (9001, "", "x", 0.5), (9002, "the nitwitt walks", "x", 0.5), (9003, "the dimwits read", "x", 0.5), (9004, "zzz " * 50000, "x", 0.5), (9004, "zzz " * 50000, "x", 0.5), (None, "the river", "x", 0.5)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(None, 1, 0), (9000, None, 1), (9001, 7, 1)], "doc_id long, toxic long, quality int")
    model = tx.train(docs, labels)
    found = [tuple(r) for r in tx.score(docs, model).collect()]
    assert len(found) == 907
    score = {k: s for k, s, _ in found}
    held = [k for k, _, _ in rows if __import__("zlib").crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(score[k] >= 0.7) == (k % 4 == 0) for k in held]) > 0.97
    assert min(score[9002], score[9003]) > 0.7 and max(score[9000], score[9001], score[9004], score[None]) < 0.7
    assert score[9000] == score[9001] and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in found)
    again = tx.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.value, model.value) and again[1:] == model[1:]


def test_labels_of_the_fold_are_not_looked_at_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts(60, 6)], "doc_id long, text string")
    labels = [(k, y) for k, _, y in texts(60, 6)]
    turned = [(k, 1 - y if __import__("zlib").crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    one, two = (tx.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert np.array_equal(one.value, two.value) and one[1:] == two[1:]
    none = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tx.score(docs, none).collect()} == {none.score(None)} and none.score("x") < 1e-9
    assert tx.score(spark.createDataFrame([], "doc_id long, text string"), one).count() == 0


def test_windows_are_bounded():
    lines = tx.windows(" ".join(f"word{k}" for k in range(20000)))
    assert len(lines) == tx.MOST_WINDOWS and all(x.count(b" ") < tx.SPAN for x in lines)
    assert tx.windows("y" * 5000) == [] and tx.windows(None) == []


def test_every_window_is_learnt_from(spark):
    """The toxic word stands only in windows that a bounded choice of windows leaves out."""
    rng, rows = random.Random(7), []
    for k in range(120):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) + str(rng.randrange(50)) for _ in range(2400)]
        if k % 2 == 0:
            kept = set(tx.windows(" ".join(words)))
            at = next(i for i in range(0, 2400, tx.SPAN) if b" ".join(w.encode() for w in words[i : i + tx.SPAN]) not in kept)
            for place in range(at, 2400):
                trial = [*words[:place], "qxzvkj", *words[place + 1 :]]
                if not any(b"qxzvkj" in x for x in tx.windows(" ".join(trial))):
                    words = trial
                    break
        rows.append((k, " ".join(words), int(k % 2 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    held = [(t, y) for k, t, y in rows if __import__("zlib").crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(model.score(t) >= 0.5) == (y == 1) for t, y in held]) > 0.9


def test_unit_has_all_windows_of_all_texts():
    texts = [" ".join(f"word{k}" for k in range(20001)), "y" * 5000, None, " \t", "A a a b"]
    unit = tx.Unit.unpacked(*tx.Unit.of((0, 0, t) for t in texts).packed())
    assert np.bincount(unit.owner, minlength=5).tolist() == [2501, 1, 0, 0, 1]
    lines = [b" ".join(unit.vocabulary[w] for w in unit.word[s : s + n]) for s, n in zip(unit.start, unit.size, strict=True)]
    assert lines[0] == b"word0 word1 word2 word3 word4 word5 word6 word7" and lines[2500:] == [b"word20000", b"y" * 5000, b"A a b"]
    model = tx.Model(np.random.default_rng(1).normal(size=1 << tx.BITS), 0.25)
    assert unit.margins([model])[0] == pytest.approx([model.margin(x.decode()) for x in lines])
    assert unit.worst([model])[0][2:] == pytest.approx([0.25, 0.25, model.margin("A a b")])


def test_a_step_is_that_of_vectors_and_softmax_trained_jointly():
    rows = [(y, k % 2, t) for k, t, y in texts(40, 8)]
    unit, first = tx.Unit.of(rows), tx.State.first()
    chosen = np.arange(len(unit.start))[:200]
    done = unit.learn({0: first, 1: first}, chosen, batch=1000)
    lines = [b" ".join(unit.vocabulary[w] for w in unit.word[s : s + n]) for s, n in zip(unit.start[chosen], unit.size[chosen], strict=True)]
    for k, at in ((0, chosen), (1, chosen[unit.halves[unit.owner[chosen]] == 0])):
        bag, y = tx.Bag([lines[i] for i in at]), unit.labels[unit.owner[at]].astype(int)
        vectors = first.vectors.astype(float)
        mean = bag.means(vectors)
        p = np.exp(mean @ first.soft)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= (0.5 * len(y) / np.bincount(y, minlength=2))[y][:, None]
        g = np.stack([np.bincount(bag.found, bag.weight * (p @ first.soft.T)[bag.window, d], 1 << tx.BITS) for d in range(tx.WIDTH)])
        assert done[k].seen == pytest.approx(g * g, abs=1e-12) and done[k].vectors == pytest.approx(vectors - g / (np.abs(g) + 0.02), abs=1e-9)
        soft = mean.T @ p / len(y)
        assert done[k].soft == pytest.approx(first.soft - 0.1 * soft / np.sqrt(1e-2 + soft * soft), abs=1e-9)


def test_changes_are_averaged_over_the_units_that_met_a_subword():
    first = tx.State.first()
    own = [tx.State(*(np.array(x, np.float64) for x in first)) for _ in range(2)]
    for k, s in enumerate(own):
        s.vectors[:, 5] += 1 + k
        s.seen[:, 5] += 4
        s.bias[1] += 2 + 2 * k
    own[1].vectors[:, 6] += 3
    own[1].seen[:, 6] += 1
    rows = [(p, u, c) for u, s in enumerate(own) for p, c in s.pieces(first)]
    pieces = [tx.averaged((pa.scalar(0), pa.scalar(p)), pa.table({"unit": [u for q, u, _ in rows if q == p], "change": [c for q, _, c in rows if q == p]})) for p in {p for p, _, _ in rows}]
    then = first.changed((t["piece"][0].as_py(), t["change"][0].as_py()) for t in pieces)
    moved = then.vectors - first.vectors
    assert moved[:, 5] == pytest.approx(1.5, abs=1e-5) and moved[:, 6] == pytest.approx(3, abs=1e-5) and not moved[:, 7:].any() and then.bias.tolist() == [0, 3]


def test_many_units_learn_as_one_does(spark, monkeypatch):
    assert [tx.dealt(x) for x in (0, 8 << 20, 17 << 20, 30 << 20, 500 << 20, 2 << 30)] == [1, 1, 2, 4, 32, 64]
    monkeypatch.setattr(tx, "LEAST_UNIT", 250_000)
    rows = texts(2700, 5)
    assert tx.dealt(sum(len(t) for k, t, _ in rows if __import__("zlib").crc32(str(k).encode()) % 3 != 1)) == 4
    docs, labels = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    held = [(t, y) for k, t, y in rows if __import__("zlib").crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(model.score(t) >= 0.7) == (y == 1) for t, y in held]) > 0.95
    again = tx.train(docs.repartition(5), labels.repartition(2))
    assert np.array_equal(again.value, model.value) and again[1:] == model[1:]
