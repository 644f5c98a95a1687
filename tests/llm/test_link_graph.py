"""Contributions of seeds against a dense solve, and verdicts that don't hang on how many others link to a seed."""

import numpy as np
import pytest

from larkspur.llm import link_graph


@pytest.mark.parametrize("linkers", [1, 100, 20_000])
def test_the_number_of_linkers_changes_no_verdict(spark, linkers):
    page = "http://{}/x", '<a href="{}">y</a>'
    rows = [("http://bad.com/de/1", ""), ("http://good.org/", "".join(f'<a href="http://friend{k}.net/">y</a>' for k in range(50)))]
    rows += [(page[0].format(f"spam{k}.net"), page[1].format("http://bad.com/de/1")) for k in range(linkers)]
    rows += [(page[0].format(f"second{k}.net"), page[1].format("http://spam0.net/")) for k in range(linkers)]
    rows += [("http://friend0.net/", ""), ("http://mostly.net/", "".join(f'<a href="http://h{k}.net/">y</a>' for k in range(40)) + '<a href="http://bad.com/">y</a>')]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    found = {(r.host[:6], r.verdict): r.n for r in link_graph.judge(table).selectExpr("regexp_replace(host, '[0-9]', '') as host", "verdict").groupBy("host", "verdict").count().withColumnRenamed("count", "n").collect()}
    assert found == {("bad.co", "block"): 1, ("good.o", "allow"): 1, ("spam.n", "block"): linkers, ("second", "block"): linkers, ("friend", "allow"): 1, ("mostly", "allow"): 1}


def test_contributions_against_a_dense_solve(spark):
    rng = np.random.default_rng(4)
    n = 30
    counts = rng.integers(1, 5, (n, n)) * (rng.random((n, n)) < 0.12) * (1 - np.eye(n, dtype=int))
    links = spark.createDataFrame([(f"h{i}", f"h{j}", int(counts[i, j])) for i, j in zip(*np.nonzero(counts), strict=True)], "source string, target string, n long")
    weights = {"trust": {"h1": 0.25, "h2": 1.0}, "distrust": {"h3": 1.0, "h29": 0.5}}
    seeds = spark.createDataFrame([(k, h, w) for k, v in weights.items() for h, w in v.items()], "kind string, host string, weight double")
    found = {(r.kind, r.host): r["rank"] for r in link_graph.propagate(links, seeds, close=1e-12, contributions=True).collect()}
    for kind, table in (("trust", counts.T), ("distrust", counts)):
        share = table / np.maximum(table.sum(1, keepdims=True), 1)
        seed = np.array([weights[kind].get(f"h{i}", 0.0) for i in range(n)])
        exact = np.linalg.solve(np.eye(n) - 0.85 * share, seed)
        assert np.allclose([found.get((kind, f"h{i}"), 0.0) for i in range(n)], exact, atol=1e-9)
