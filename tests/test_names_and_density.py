"""Names in texts and files against plain search, and main texts against the rule block by block, and their recall on pages."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.functions import density
from larkspur.operators import names


def table(spark, said):
    return spark.createDataFrame([(n,) for n in said], "name string")


def test_names_against_plain_search(spark):
    rng = random.Random(2)
    known = ["Anna", "anna muster", "ANNA", "Muster", "ster Ur", "é", "ü Ö", None, " ", "zz"] + ["".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(60)]
    texts = ["Anna Muster Urs", "", None, "É ist ü ö", *("".join(rng.choices("aAbB ", k=rng.randint(0, 60))) for _ in range(80))]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, text string, name string")
    found = sorted(tuple(r) for r in names.named_in(rows, table(spark, known), "k", "text").collect())
    assert found == sorted((k, n) for k, t in enumerate(texts) for n in {n for n in known if n and n.strip()} if t and n.lower() in t.lower())
    assert names.named_in(rows, table(spark, [None]), "k", "text").count() == 0 and names.named_in(rows.limit(0), table(spark, ["x"]), "k", "text").count() == 0


def test_files_that_still_name_somebody(spark, tmp_path):
    (tmp_path / "notes" / "deep er").mkdir(parents=True)
    (tmp_path / ".venv").mkdir()
    (tmp_path / "notes" / "a.txt").write_text("first\nwrote to anna MUSTER today\n" * 3)
    (tmp_path / "notes" / "deep er" / "b.bin").write_bytes(b"\xff\xfe\x00" + b"x" * 300_000 + "Zoé Fritz".encode() + b"y" * 300_000)
    (tmp_path / "notes" / "c.txt").write_text("nobody")
    (tmp_path / ".venv" / "d.txt").write_text("Anna Muster")
    (tmp_path / "notes" / "e.gz").write_bytes(gzip.compress(b"Anna Muster"))
    (tmp_path / "f.db.ZIP").write_bytes(b"PK")
    found = {(r.path.split(str(tmp_path))[1], r.name) for r in names.still_named(spark, f"file://{tmp_path}", table(spark, ["Anna Muster", "Zoé Fritz", "Urs"])).collect()}
    assert found == {("/notes/a.txt", "Anna Muster"), ("/notes/deep er/b.bin", "Zoé Fritz"), ("/notes/e.gz", None), ("/f.db.ZIP", None)}


def test_too_many_names_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(names, "MOST_NAMES", 3)
    rows = spark.createDataFrame([(1, "a b c d")], "k int, text string")
    assert names.named_in(rows, table(spark, "abc"), "k", "text").count() == 3
    with pytest.raises(ValueError, match="more than 3 names"):
        names.named_in(rows, table(spark, "abcd"), "k", "text")


def plain(html):
    """main text, by the published rule."""
    if html is None:
        return None
    strip = lambda x: " ".join(re.sub(density.TAG_PATTERN, "", x).replace("&nbsp;", " ").replace("&lt;", "<").replace("&gt;", ">").replace("&copy;", "©").replace("&amp;", "&").split())
    parts = re.split(density.BLOCK_PATTERN, re.sub(density.UNSEEN_PATTERN, " ", html))
    found = [(strip(p), " ".join(strip(x) for x in re.findall(density.LINK_PATTERN, p)).split()) for p in parts]
    found = [(t, len(t.split()), len(linked)) for t, linked in found if t]
    none, main = ("", 0, 0), []
    for i, (text, n, linked) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        d, bd = linked / n, before[2] / before[1] if before[1] else 0
        keep = d <= 0.333333 and ((n > 16 or after[1] > 15 or before[1] > 4) if bd <= 0.555556 else (n > 40 or after[1] > 17))
        main.append((text, n, keep))
    few, every = sum(n for _, n, k in main if k), sum(n for _, n, _ in main)
    return "\n".join(t for t, _, k in main if k or (few < 80 and every > few))


def pages():
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma&nbsp;x", "d&amp;e", "ö"]) for _ in range(n))
    out = [None, "", "no tags at all", "<p>one</p>", "<a href=x>" + "y " * 50 + "</a>", "<div><script>var a='<p>x</p>';</script><p>a<b>b</b>c<br/>d</p></div>", "<!-- <p>hidden</p> --><P CLASS='x'>A  B\n C</P>"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 14)):
            text = words(rng.choice([1, 3, 5, 16, 17, 30, 60]))
            parts.append(rng.choice(["<p>{}</p>", "<li><a href='/x'>{}</a></li>", "<div class=a>{} <a>" + words(4) + "</a></div>", "<td>{}", "{}<br>", "<h2>{}</h2>", "<style>{}</style>", "<span>{}</span>"]).format(text))
        out.append("<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>")
    return out


def test_main_text_against_the_rule(spark):
    said = pages()
    rows = spark.createDataFrame([(k, x, "kept") for k, x in enumerate(said)], "k int, html string, text string")
    found = {r.k: (r.main_text, r.text) for r in density.with_main_text(rows).collect()}
    assert found == {k: (plain(x), "kept") for k, x in enumerate(said)}


def test_recall_of_articles(spark):
    """Of the words of long paragraphs in pages' articles nearly all are found, and nearly none of menus."""
    rows = density.with_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where(F.col("html").contains("<article"))).select("html", "main_text").collect()
    there = total = menu = menus = 0
    for r in rows:
        lines = set(r.main_text.split("\n"))
        for p in re.findall(r"(?s)<p>(.*?)</p>", r.html.split("<article")[1].split("</article")[0]):
            text = " ".join(re.sub("<[^>]*>", "", p).split())
            if len(text.split()) > 30 and "&" not in text and "<" not in p:
                total, there = total + 1, there + (text in lines)
        if total and len(r.main_text.split()) > 80:
            for a in re.findall(r"<li><a [^>]*>(.*?)</a></li>", r.html):
                menus, menu = menus + 1, menu + (a in lines)
    assert total > 50 and there / total > 0.95 and menu <= 0.2 * menus, (there, total, menu, menus)
