"""The search for sites against one company after the other in plain Python, with and without a second provider, and broken off."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import site_search as ss

TOLD = "uid long, query string, provider string, error string, urls array<string>"
PAGES = "url string, text string, refused string, lasting boolean, final string"
DOMAINS = [f"d{k}.ch" for k in range(12)] + ["directory.ch"]
BLOCKED = ("directory.ch",)
MOST = 3


def domain(url):
    return ".".join(url.split("/")[2].split(".")[-2:])


def cases(n, seed):
    rng = random.Random(seed)
    url = lambda: f"https://{rng.choice(['', 'www.', 'de.'])}{rng.choice(DOMAINS)}/{rng.choice('ab')}"
    told, companies = {}, []
    for uid in range(n):
        mood = rng.random()
        for q in ("q0", "q1", "q2", "narrow"):
            for provider in ("first", "second"):
                r = rng.random()
                error = "timeout" if r < (0.5 if mood < 0.3 else 0.05) else None
                urls = [] if error or r < 0.4 or mood > 0.7 and q != "q2" else [rng.choice([url(), "https://www.directory.ch/x"]) for _ in range(rng.randint(0, 3))]
                told[uid, q, provider] = (error, urls)
        companies.append((uid, rng.choice([None, "every candidate refused (wall)", "timeout"]), [url()] if rng.random() < 0.15 else []))
    pages = {}
    for d in DOMAINS:
        for sub in ("", "www.", "de."):
            for end in "ab":
                r = rng.random()
                refused = ("wall", True) if r < 0.3 else ("timeout", False) if r < 0.4 else (None, None)
                pages[f"https://{sub}{d}/{end}"] = (" " if r > 0.9 else rng.choice(["yes", "no", "no"]), *refused, rng.choice([None, "https://www.new.ch/x", f"https://{d}/home"]))
    return companies, told, pages


class Stop(Exception):
    pass


def one(uid, previous, guesses, told, pages, second, again):
    """site, verdict and reason of a company. again: what the first provider says the second time."""
    answered = set()

    def ask(query, provider="first", source=told):
        error, urls = source[uid, query, provider]
        if error and provider == "first" and second:
            return ask(query, "second")
        if error:
            raise Stop(("error", f"search failed: {query}: {error}"))
        if provider == "second":
            answered.add(query)
        return urls

    def every(source=told):
        out, bad = [], []
        for q in ("q0", "q1", "q2"):
            try:
                out += ask(q, source=source)
            except Stop as e:
                bad.append(e.args[0])
        if bad:
            raise Stop(min(bad))
        return out

    def pick(urls, most=MOST):
        first = {}
        for u in urls:
            d = domain(u)
            if d in BLOCKED:
                continue
            bare = u.split("/")[2].removeprefix("www.")
            if d not in first:
                first[d] = [u, bare == d]
            elif bare == d and not first[d][1]:
                first[d] = [u, True]
        return [u for u, _ in first.values()][:most]

    def choose(urls):
        read = [(u, *pages[u]) for u in urls]
        if read and all(r[2] for r in read):
            lasting, why = all(r[3] for r in read), ", ".join(sorted(r[2] for r in read))
            if lasting:
                raise Stop(("skip" if (previous or "").startswith("every candidate refused") else "error", f"every candidate refused ({why})"))
            raise Stop(("error", f"no candidate site could be read ({why})"))
        fits = []
        for u, text, refused, _, final in read:
            if not refused and text == "yes":
                fits.append("https://www.new.ch/" if final and domain(final) != domain(u) else u)
        return min(fits, default=None)

    try:
        found = every()
        if not found and second:
            bad = []
            for q in ("q0", "q1"):
                if q not in answered:
                    try:
                        found = found + ask(q, "second")
                    except Stop as e:
                        bad.append(e.args[0])
            if bad:
                raise Stop(min(bad))
        elif not found:
            found = every(again)
            if not found:
                raise Stop(("error", ss.SILENT))
        if not pick(found):
            found = found + ask("narrow")
        candidates = pick([*guesses, *found])
        site, n = choose(candidates), len(candidates)
        if site is None and second and "q0" not in answered:
            new = [u for u in pick(ask("q0", "second")) if domain(u) not in {domain(c) for c in candidates}]
            site, n = choose(new), n + len(new)
    except Stop as e:
        return (None, *e.args[0])
    if site:
        return site, "site", None
    looked = f", {n} candidate(s) checked" if n else ""
    return None, "skip", f"no website found after 3 searches and a domain guess{looked}" + ("; Brave was also asked" if "q0" in answered else "")


def outside(spark, told, pages, second, again, asked):
    table = lambda x: spark.createDataFrame([(*k, *v) for k, v in x.items()], TOLD).cache()
    first, later = table(told), table(again)
    read = spark.createDataFrame([(u, *v) for u, v in pages.items()], PAGES)

    def ask(wanted):
        asked.append("ask")
        source = later if not second and asked.count("ask") == 2 else first  # the second superstep that asks is the one after silence
        return wanted.join(source, ["uid", "query", "provider"])

    def reading(wanted):
        asked.append("read")
        return wanted.join(read, "url")

    choose = lambda texts: texts.where("text = 'yes'").groupBy("uid").agg(F.min("url").alias("url"))
    return ss.Outside(ask, reading, choose, second, BLOCKED, MOST)


def table(spark, companies):
    rows = spark.createDataFrame(companies, "uid long, previous_error string, guesses array<string>")
    return rows.select("uid", F.array(*map(F.lit, ("q0", "q1", "q2"))).alias("queries"), F.lit("narrow").alias("narrowing"), "previous_error", "guesses")


@pytest.mark.parametrize("second", [True, False])
def test_search_against_one_by_one(spark, tmp_path, second):
    companies, told, pages = cases(400, 11)
    again = {k: (None if k[0] % 2 else v[0], v[1] if k[0] % 3 else []) for k, v in cases(400, 12)[1].items()}
    out = outside(spark, told, pages, second, again, [])
    found = {r.uid: (r.site, r.verdict, r.reason) for r in ss.search(table(spark, companies), out, f"file://{tmp_path}").collect()}
    expected = {uid: one(uid, previous, guesses, told, pages, second, again) for uid, previous, guesses in companies}
    assert found == expected
    kinds = {(v, (r or "")[:12]) for _, v, r in expected.values()}
    assert len(kinds) >= (6 if second else 7)


@pytest.mark.parametrize("name", ["ask", "narrow", "read", "confirm", "conclude"])
def test_a_search_that_broke_off_goes_on(spark, tmp_path, name, monkeypatch):
    companies, told, pages = cases(120, 5)
    whole = {tuple(r) for r in ss.search(table(spark, companies), outside(spark, told, pages, True, told, []), f"file://{tmp_path}/whole").select("uid", "site", "verdict", "reason").collect()}

    def broken(rows, out):
        raise RuntimeError("lost")

    asked = []
    out = outside(spark, told, pages, True, told, asked)
    with monkeypatch.context() as m:
        m.setitem(ss._CHANGES, name, broken)
        with pytest.raises(RuntimeError):
            ss.search(table(spark, companies), out, f"file://{tmp_path}/broken")
    before = len(asked)
    found = {tuple(r) for r in ss.search(table(spark, companies), out, f"file://{tmp_path}/broken").select("uid", "site", "verdict", "reason").collect()}
    assert found == whole
    first = len(asked)
    ss.search(table(spark, companies), out, f"file://{tmp_path}/broken").count()
    assert len(asked) == first >= before  # all is read, nothing asked
