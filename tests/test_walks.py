"""Walks of many sites against a queue for each."""

import random

import pytest

from larkspur.operators import walks


def queue(site, start, maps, home, limit):
    found, seen, pending = [], set(), [start]
    while pending and len(found) < 10 * limit:
        url = pending.pop(0)
        if url in seen or url not in maps:
            seen.add(url)
            continue
        seen.add(url)
        pages, nested = maps[url]
        found += pages
        pending += nested[: walks.NESTED]
    return [*(found or home), site]


def case(seed):
    rng = random.Random(seed)
    maps = {}
    for k in range(60):
        if rng.random() < 0.85:
            maps[f"m{k}"] = ([f"p{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 3]))], [f"m{rng.randrange(70)}" for _ in range(rng.choice([0, 1, 2, 25]))])
    sites = {f"s{k}": f"m{rng.randrange(65)}" for k in range(40)}
    homes = {s: [f"{s}/{i}" for i in range(rng.randint(0, 2))] for s in sites}
    return maps, sites, homes


def run(spark, maps, sites, homes, limit, root):
    tables = (
        spark.createDataFrame(list(sites.items()), "site string, start string"),
        spark.createDataFrame([(u, *v) for u, v in maps.items()], "url string, pages array<string>, nested array<string>"),
        spark.createDataFrame(list(homes.items()), "site string, links array<string>"),
    )
    out = {}
    for r in sorted(walks.sitemap_pages(*tables, limit, root).collect(), key=lambda r: (r.site, r.n)):
        out.setdefault(r.site, []).append(r.url)
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 1), (2, 3)])
def test_walk_against_a_queue(spark, tmp_path, seed, limit):
    maps, sites, homes = case(seed)
    found = run(spark, maps, sites, homes, limit, f"file://{tmp_path}")
    assert found == {s: queue(s, start, maps, homes[s], limit) for s, start in sites.items()}


def test_a_walk_that_broke_off_goes_on(spark, tmp_path):
    maps, sites, homes = case(3)
    whole = run(spark, maps, sites, homes, 2, f"file://{tmp_path}/a")
    rounds = sorted((tmp_path / "a").glob("round-*"))
    assert len(rounds) > 2
    (rounds[-1] / "_SUCCESS").unlink()
    stamps = {r: (r / "_SUCCESS").stat().st_mtime_ns for r in rounds[:-1]}
    assert run(spark, maps, sites, homes, 2, f"file://{tmp_path}/a") == whole
    assert {r: (r / "_SUCCESS").stat().st_mtime_ns for r in rounds[:-1]} == stamps


def test_no_sites(spark, tmp_path):
    assert walks.sitemap_pages(spark.createDataFrame([], "site string, start string"), spark.createDataFrame([], "url string, pages array<string>, nested array<string>"), spark.createDataFrame([], "site string, links array<string>"), 1, f"file://{tmp_path}").count() == 0


def test_links_are_followed_to_the_end_and_never_back(spark, tmp_path):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), *((f"x{k}", f"x{k + 1}") for k in range(14))], "source string, target string")
    start = spark.createDataFrame([("a",), ("x0",), ("a",)], "url string")
    found = {(r.url, r.depth) for r in walks.reached(links, start, None, f"file://{tmp_path}/all").collect()}
    assert found == {("a", 0), ("b", 1), ("c", 2), *((f"x{k}", k) for k in range(15))}
    assert walks.reached(links, start, 4, f"file://{tmp_path}/some").count() == 4


def test_maps_are_stored_once_for_all_rounds(spark, tmp_path):
    sites = spark.createDataFrame([(1, "m1")], "site long, start string")
    maps = spark.createDataFrame([("m1", [], ["m2"]), ("m2", [], ["m3"]), ("m3", ["p"], [])], "url string, pages array<string>, nested array<string>")
    homes = spark.createDataFrame([], "site long, links array<string>")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    found = walks.sitemap_pages(sites, maps.coalesce(1).mapInPandas(counted, maps.schema), homes, 5, f"file://{tmp_path}/w")
    assert [r.url for r in found.orderBy("n").collect()] == ["p", "1"]
    assert read.value == 3
