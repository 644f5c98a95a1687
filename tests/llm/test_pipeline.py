"""The pipeline's stages on a small table, each held against what it must do."""

import random

import pytest

import corpus_pipeline
from larkspur.llm import secrets, simhash

from .test_llm import frame, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    good = prose(60, 21)
    junk = [" | ".join(t.split()) + " ### $$$" for t in prose(60, 22)]
    leak = "a question about kappa and theta that only the benchmark should ever hold word for word"
    texts = [t for pair in zip(good, junk, strict=True) for t in pair] + [good[0], good[1], f"{good[2]} {leak} {good[3]}", f"{good[4]} {good[5]} password = hunter22 {good[6]}"]
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, 1 - k % 2 if k < 120 else 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        kept[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    first, near, clean, told, packed = (kept[n] for n, _ in corpus_pipeline.STAGES)
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(first) == {k for k in range(124) if k >= 120 or k % 2 == 0}
    assert ids(near) == ids(first) - {120, 121} or ids(near) < ids(first) - {120, 121}
    assert 122 in ids(near) and ids(clean) == ids(near) - {122}
    assert ids(told) == ids(clean) and "hunter22" not in next(r.text for r in told if r.doc_id == 123) and "<secret>" in next(r.text for r in told if r.doc_id == 123)
    assert all(list(r.asDict()) == columns for rows in (first, near, clean, told) for r in rows[:1])
    assert {r.text for r in told if r.doc_id != 123} == {r.text for r in clean if r.doc_id != 123} and ids(packed) == ids(told)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert secrets.RULES


def templated(pairs, seed, words=1000, family=0.92, pair=0.91):
    """Texts of one template, two and two: each pair has a copy of the template with its own words, and the second some more. Similarities are measured, not assumed."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10**6)}" for _ in range(words)]
    def blocks(text, share, salt):
        out, at = list(text), 0
        left = round(len(text) * (1 - share))
        while left > 0:  # words are changed in runs, so that few shingles are
            at, n = rng.randrange(len(text)), min(left, 40)
            for k in range(at, min(at + n, len(text))):
                out[k] = f"{salt}{rng.randrange(10**6)}"
            left -= n
        return out
    out = []
    for k in range(pairs):
        one = blocks(base, family, f"a{k}x")
        out += [one, blocks(one, pair, f"b{k}x")]
    return [" ".join(t) for t in out]


def shares(texts, width=5):
    """The similarity of each two texts that are alike to 0.6 or more, by brute force."""
    sets = [{" ".join(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in texts]
    return {(i, j): len(a & sets[j]) / len(a | sets[j]) for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.6 * len(a | sets[j])}


@pytest.mark.parametrize("family", [0.92, 0.3])
def test_near_dedup_finds_pairs_among_look_alikes(spark, family):
    texts = templated(100, 7, family=family)
    alike = shares(texts)
    true = {p for p, s in alike.items() if s >= 0.8}
    if family > 0.5:
        assert len(alike) > 20 * len(true)  # far more texts are nearly alike than are alike
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, texts)).collect()}
    together = sum(found[i] == found[j] for i, j in true) / len(true)
    assert len(true) > 50 and together >= 0.9, together
    groups = {}
    for i, j in true:
        for x in (i, j):
            groups.setdefault(x, {x})
        both = groups[i] | groups[j]
        for x in both:
            groups[x] = both
    assert all(found[i] in groups.get(i, {i}) for i in range(len(texts)))  # nobody is put with a text that isn't alike


def test_unlike_texts_of_one_doc_id_stay(spark):
    texts = [" ".join(prose(4, seed)) for seed in range(31, 34)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " more"), (3, texts[2]), (3, texts[2]), (None, texts[0]), (None, texts[0]), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), str(r.text)[:9]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted([("1", texts[0][:9]), ("1", texts[1][:9]), ("3", texts[2][:9]), ("None", texts[0][:9]), ("None", texts[0][:9]), ("4", "None")])


def test_only_leaking_texts_of_a_doc_id_go(spark, tmp_path):
    leak = "a question about kappa and theta that only the benchmark should ever hold word for word"
    texts = prose(4, 33)
    rows = [(1, texts[0]), (1, f"{texts[1]} {leak} {texts[2]}"), (2, leak), (None, leak), (3, texts[3])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()}
    assert kept == {(1, texts[0]), (None, leak), (3, texts[3])}
