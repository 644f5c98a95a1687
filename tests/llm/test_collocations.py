"""Collocations against plain counting, with sketches that are exact, crowded and full."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import collocations as co


def brute(rows, least, most):
    """rows: (text, lang)."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = set()
        for p, c in frequent.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * c >= 100 * counts[p[i:j]]:
                        inside.add(p[i:j])
        scores = []
        for p, a in frequent.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scores.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out)


def rows(n, seed):
    rng = random.Random(seed)
    fixed = ["as well as", "in front of the", "New York City", "été ça va", "one two three four five six"]
    out = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(1, 40)):
            words.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice("abcdefgh") * rng.randint(1, 2))
            words.append(rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " "]))
        out.append(("".join(words), rng.choice(["en", "de", None, "und"])))
    return [*out, ("", "en"), (None, "de"), ("...", "fr"), ("the the " * 3000, "en"), ("x y z " * 50, ""), *out[:20]]


@pytest.mark.parametrize(("bits", "window"), [(None, co.WINDOW), (16, 300), (3, 1000)])
def test_against_plain_counting(spark, bits, window):
    said = rows(300, 4)
    docs = spark.createDataFrame([(k, t, l, "x", 1) for k, (t, l) in enumerate(said)], "doc_id long, text string, lang string, phrase string, f int").repartition(5)
    found = sorted(tuple(r) for r in co.mine(docs, 20, 60, bits, window).collect())
    assert found == brute(said, 20, 60)
    assert {r[0] for r in found} >= {"en", "de", "und"}


def test_a_sketch_never_counts_too_little(spark):
    said = [(t or "", "en") for t, _ in rows(200, 8)]
    docs = spark.createDataFrame(said, "text string, lang string").repartition(4)
    for bits in (6, 12):
        bit = co.sketch(docs, 25, bits)
        words, _, seeds = co._read([t.encode() for t, _ in said], ["en"] * len(said))
        for n, at, key in co.grams(words, seeds):
            hashes, times = np.unique(key, return_counts=True)
            cells = [(row[c >> 3] >> (7 - (c & 7)) & 1) for row, c in zip(bit, co.cells(hashes, bits), strict=True)]
            assert all(c[times >= 25].all() for c in cells)


def test_counts_are_added_up_in_tasks(spark):
    said = [(t or "", "en") for t, _ in rows(200, 9)]
    docs = spark.createDataFrame(said, "text string, lang string").coalesce(1)
    bit = [np.full(2, 255, np.uint8)] * 2
    found = {held: sorted(tuple(r) for r in co.count_survivors(docs, bit, 4, 500, held).collect()) for held in (1, 700, co.HELD)}
    assert found[1] == found[700] == found[co.HELD] and len(found[1]) > 1000
    assert sum(f for _, size, _, f in found[1] if size == 1) == next(f for _, size, _, f in found[1] if size == 0)


def test_numbers_tell_words_apart():
    words, _, _ = co._read([b"one two, one\tThree one. twos two", b"two"], ["en", "de"])
    said = [words.codes[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    assert said == [b"one", b"two", b"one", b"three", b"one", b"twos", b"two", b"two"]
    number = words.numbers()
    assert all((number[i] == number[j]) == (said[i] == said[j]) for i in range(8) for j in range(8))
    assert co._strings(words, np.array([2, 0, 5]), 2).to_pylist() == ["one three", "one two", "twos two"]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000_007
    counts = spark.createDataFrame([("en", 0, "", 10**15 + 37), ("en", 1, "a", big), ("en", 1, "b", big + 4), ("en", 2, "a b", big - 9)], "lang string, size int, phrase string, f long")
    (row,) = co.scored(counts, 10).collect()
    assert row.score == 1000 * (big - 9) * (10**15 + 37) // (big * (big + 4)) and row["rank"] == 1


def test_empty_table(spark):
    assert co.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_longer_ones_have_a_sketch_of_their_own_where_one_would_fill_up(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijkl") for _ in range(rng.randrange(60))) + " sie sah das alte haus. so war es" for _ in range(300)]
    docs = spark.createDataFrame([(t, "de") for t in texts], "text string, lang string")
    one, two = (sorted(tuple(r) for r in co.mine(docs, 20, 2000, 16, 900, full).collect()) for full in (1 << 30, 0))
    assert one == two and one
    short = co.sketch(docs, 20, 8, 900, (1, 2))
    longer = co.sketch(docs, 20, 12, 900, (3, 4, 5), co.sketch(docs, 20, 12, 900, (1, 2)))
    every = co.sketch(docs, 20, 12, 900)
    assert np.unpackbits(short[0]).all() and np.unpackbits(longer[0]).sum() < np.unpackbits(every[0]).sum() / 2
