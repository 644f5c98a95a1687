"""Registered domains against the algorithm as it is published, label by label."""

import os
import random

import pytest

from larkspur.functions import suffixes

LIST = """// ===BEGIN ICANN DOMAINS===
com
ck
*.ck
!www.ck
co.za
za // a remark
uk
co.uk
jp
kobe.jp
*.kobe.jp
!city.kobe.jp
公司.cn
cn
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
io
*.compute.example.com
wixsite.com
// ===END PRIVATE DOMAINS===
"""
PUBLIC = "/usr/share/publicsuffix/public_suffix_list.dat"


def plain(host, rules):
    """domain, suffix, private: walking all rules for all ends of the host."""
    bare = host.strip().lower().rstrip(".")
    labels, fits = bare.split("."), []
    for rule, kind, private in rules:
        parts = rule.split(".")
        if labels[-len(parts) :] == parts:
            n = len(parts) + (1 if kind == suffixes.WILDCARD else -1 if kind == suffixes.EXCEPTION else 0)
            if n <= len(labels):
                fits.append((kind == suffixes.EXCEPTION, n, not private, private))
    if not fits or max(fits)[1] >= len(labels):
        return bare.removeprefix("www."), None, False
    n, private = max(fits)[1], max(fits)[3]
    return ".".join(labels[-n - 1 :]), ".".join(labels[len(labels) - n :]), private


def domains(spark, hosts, rules):
    table = spark.createDataFrame(rules, suffixes.RULES)
    found = suffixes.resolved(spark.createDataFrame([(h,) for h in hosts], "host string"), table)
    return {r.host: (r.domain, r.suffix, r.private) for r in found.collect()}


def test_named_cases(spark):
    found = domains(spark, ["x.co.za", "a.y.co.za", "co.za", "a.b.ck", "b.ck", "www.ck", "a.www.ck", "x.b.kobe.jp", "city.kobe.jp", "a.city.kobe.jp", "muster.github.io", "a.b.compute.example.com", "example.com", "127.0.0.1", "muster.example", "www.muster.example", "WWW.De.Muster.CO.UK.", "a.xn--55qx5d.cn", "a.公司.cn"], suffixes.parsed(LIST))
    assert {h: d for h, (d, _, _) in found.items()} == {
        "x.co.za": "x.co.za", "a.y.co.za": "y.co.za", "co.za": "co.za", "a.b.ck": "a.b.ck", "b.ck": "b.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "x.b.kobe.jp": "x.b.kobe.jp", "city.kobe.jp": "city.kobe.jp",
        "a.city.kobe.jp": "city.kobe.jp", "muster.github.io": "muster.github.io", "a.b.compute.example.com": "a.b.compute.example.com", "example.com": "example.com", "127.0.0.1": "127.0.0.1", "muster.example": "muster.example",
        "www.muster.example": "muster.example", "WWW.De.Muster.CO.UK.": "muster.co.uk", "a.xn--55qx5d.cn": "a.xn--55qx5d.cn", "a.公司.cn": "a.公司.cn",
    }
    assert [found[h][2] for h in ("muster.github.io", "a.b.compute.example.com", "example.com", "x.co.za")] == [True, True, False, False]


@pytest.mark.parametrize("source", ["own", "public"])
def test_against_the_published_algorithm(spark, source):
    if source == "public" and not os.path.isfile(PUBLIC):
        pytest.skip("no list on this machine")
    rules = suffixes.parsed(LIST if source == "own" else open(PUBLIC, encoding="utf-8").read())
    rng, some = random.Random(3), [r for r in rules if r[1]] + random.Random(4).sample(rules, min(len(rules), 150))
    hosts = {".".join([*rng.choices(["www", "a", "city", "x-y"], k=rng.randint(0, 3)), rng.choice(some)[0]]) for _ in range(500)}
    found = domains(spark, sorted(hosts), rules)
    by_end = {}
    for r in rules:
        by_end.setdefault(r[0], []).append(r)
    for host in hosts:
        labels = host.split(".")
        mine = [r for i in range(len(labels)) for r in by_end.get(".".join(labels[i:]), [])]
        assert found[host] == plain(host, mine), host


def test_domains_of_urls(spark):
    rules = suffixes.suffix_rules(spark)
    said = ["https://www.muster.ch/x", "https://de.muster.ch", "https://muster.jimdosite.com/", "https://a@x.co.uk:80/", "muster", None, "https://www.muster.ch/x"]
    rows = spark.createDataFrame([(k, u, "kept", 1) for k, u in enumerate(said)], "k int, url string, suffix string, host int")
    found = {r.k: (r.domain, r.inbox_domain, r.suffix) for r in suffixes.with_domain(rows, rules).collect()}
    assert found == {0: ("muster.ch", "muster.ch", "kept"), 1: ("muster.ch", None, "kept"), 2: ("muster.jimdosite.com", None, "kept"), 3: ("x.co.uk", "x.co.uk", "kept"), 4: (None, None, "kept"), 5: (None, None, "kept"), 6: ("muster.ch", "muster.ch", "kept")}


def test_a_list_in_a_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text(LIST, encoding="utf-8")
    rules = suffixes.suffix_rules(spark, f"file://{tmp_path}/list.dat")
    assert rules.where("suffix = 'www.ck' and kind = 2").count() == 1 and rules.where("private and suffix = 'jimdo.com'").count() == 1
