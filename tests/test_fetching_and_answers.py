"""Redirects against a loop in Python, gaps between questions to a host, and typed answers."""

import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from larkspur.operators import fetching
from larkspur.plans import answers

BASES = ["https://a.ch", "https://a.ch/", "https://a.ch/x", "https://a.ch/x/y/z.html?q=1#f", "http://a.ch:80/x/y/", "https://a.ch/x?u=/p/../q"]
REFS = ["", "b", "b/", "/b", "//c.ch/d", "https://e.ch/f/../g", "?q", "#f", "./b", "../b", "../../b", "../../../b", "b/../c", "b/./c/", ".", "..", "../", "./", "/b/../c?x=/../y", "mailto:a@b.ch", "b?x=../y", "/..", "a/b/../../c"]


def test_references_are_joined_as_urls_are(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    found = {(x.b, x.r): x.v for x in spark.createDataFrame(rows, "b string, r string").select("b", "r", fetching.joined(F.col("b"), F.col("r")).alias("v")).collect()}
    odd = {(b, r): (v, urljoin(b, r)) for (b, r), v in found.items() if v != urljoin(b, r) and not (r == "https://e.ch/f/../g" and v == r)}
    assert odd == {}


def loop(url, answers_, most=5):
    current = url
    for _ in range(most + 1):
        host = current.split("/")[2] if "://" in current else ""
        if not current.startswith(("http://", "https://")):
            return current, None, f"refused scheme '{current.split(':')[0].lower() if ':' in current else ''}'"
        if not host:
            return current, None, "refused: no host in the URL"
        if host in ("localhost", "127.0.0.1", "10.1.2.3"):
            return current, None, f"refused {host}: not a public address"
        if current not in answers_:
            return current, None, "no answer is recorded"
        status, location = answers_[current]
        if not 300 <= status < 400:
            return current, status, f"HTTP {status}" if status >= 400 else None
        if not location:
            return current, status, f"HTTP {status} without a location"
        current = urljoin(current, location)
    return current, None, "more than 5 redirects"


def test_redirects_against_a_loop(spark):
    rng = random.Random(3)
    urls = [f"https://h{k % 4}.ch/p{k}" for k in range(40)]
    known = {}
    for k, u in enumerate(urls[:36]):
        r = rng.random()
        known[u] = (200, None) if r < 0.2 else (rng.choice([404, 500]), None) if r < 0.25 else (302, rng.choice([None, "", "http://10.1.2.3/x", "ftp://a.ch/", "http://localhost/", f"/p{k + 4}"])) if r < 0.4 else (301, rng.choice([urls[(k + 1) % 40], f"/p{(k + 4) % 40}", f"//h1.ch/p{(k + 5) % 40}"]))
    known[urls[36]] = (302, "/p36")
    asked = [*urls, urls[0], "http://127.0.0.1/a", "javascript:x", "https:///x", ""]
    table = spark.createDataFrame([(u, s, x) for u, (s, x) in known.items()], "url string, status int, location string")
    found = sorted((r.url, r.final_url, r.status, r.error or "") for r in fetching.followed(spark.createDataFrame([(u, "x") for u in asked], "url string, error string"), table).collect())
    assert found == sorted((u, f, s, e or "") for u in asked for f, s, e in [loop(u, known)])
    assert sum("more than 5" in e for *_, e in found) > 0


def test_hosts_are_asked_with_gaps_and_in_turns(spark):
    asked = [f"https://h{k % 3}.ch/{k}" for k in range(12)] + ["https://slow.ch/1", "https://slow.ch/2", "https://bad.ch/"]

    def ask(url):
        if "bad" in url:
            raise OSError("down")
        return url[-1]

    delays = spark.createDataFrame([("slow.ch", 0.5)], "host string, delay double")
    rows = spark.createDataFrame([(u,) for u in asked], "url string").coalesce(1)
    began = time.monotonic()
    found = fetching.asked_politely(rows, ask, 0.2, delays).collect()
    took = time.monotonic() - began
    by = {}
    for r in found:
        by.setdefault(r.host, []).append(r.asked_at)
    gaps = {h: min((b - a for a, b in zip(sorted(v), sorted(v)[1:], strict=False)), default=9) for h, v in by.items()}
    assert all(gaps[h] >= 0.19 for h in ("h0.ch", "h1.ch", "h2.ch")) and gaps["slow.ch"] >= 0.49 and took < 12
    assert {(r.url, r.error_kind) for r in found if r.error_kind} == {("https://bad.ch/", "OSError")} and len(found) == len(asked)


@pytest.mark.parametrize(("text", "status", "finish", "error", "tries"), [
    ('{"score": 3, "more": {"a": [1.5]}}', 200, "stop", None, 1), ('{"score": 3, "more": null, "extra": 1}', 200, "stop", None, 1), ('{"score": true}', 200, "stop", "unusable", 3), ('{"score": "3"}', 200, "stop", "unusable", 3), ('{"more": null}', 200, "stop", "unusable", 3),
    ('{"score": 3, "more": {"a": ["x"]}}', 200, "stop", "unusable", 3), ("[]", 200, "stop", "unusable", 3), ('{"sco', 200, "length", "truncated", 1), ('{"score": 3}', 200, "length", None, 1), ("", 400, "", "rejected", 1), ("", 408, "", "unusable", 3), ("", 429, "", "unusable", 3), ("", 500, "", "unusable", 3),
])
def test_what_is_asked_again(spark, tmp_path, text, status, finish, error, tries):
    log = str(tmp_path / "log")

    def ask(prompt, attempt):
        with open(log, "a") as f:
            f.write(f"{attempt}\n")
        return {"status": status, "text": text, "finish_reason": finish, "model": "m", "prompt_tokens": 5}

    rows = spark.createDataFrame([(1, "p", "x")], "key int, prompt_text string, model string")
    (r,) = answers.typed_answers(rows, ask, "score int not null, more struct<a: array<double>>", "score", "v1", attempts=3).collect()
    assert r.error_kind == error and open(log).read().split() == [str(k + 1) for k in range(tries)]
    assert (r.answer.score if not error else r.answer) == (3 if not error else None) and (r.prompt, r.prompt_version, r.reasoning_effort) == ("score", "v1", "low")
    assert error == "unusable" or (r.model, r.prompt_tokens, r.completion_tokens, r.attempts) == ("m", 5, None, 1)
