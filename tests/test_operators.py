import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import candidates, eligibility, ledger, report, retention, upsert
from larkspur.streaming import decisions as streams

LEDGER = "id long, uid long, status string, decided_at timestamp, reverses long, arm string, frame_version string, contact_kind string"
DAY = datetime.datetime(2026, 3, 1, 9)


def rows(spark, *said):
    return spark.createDataFrame([(i, u, s, DAY + datetime.timedelta(days=i), r, "voll", None, None) for i, u, s, r in said], LEDGER)


def model(said):
    """What stands for each company, by hand."""
    undone = {r for _, _, s, r in said if s == "undone" and r is not None}
    out = {}
    for i, u, s, r in sorted(said):
        if i not in undone and not (s == "undone" and r is not None):
            out[u] = (i, s)
    return {u: x for u, x in out.items() if x[1] not in ledger.REOPENING}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(ledger.STATUSES), st.one_of(st.none(), st.integers(1, 12))), max_size=12))
def test_decisions_against_a_model(spark, said):
    said = [(k + 1, u, s, r) for k, (u, s, r) in enumerate(said)]
    found = {r.uid: (r.id, r.status) for r in ledger.current_decision(rows(spark, *said)).collect()}
    assert found == model(said)


def test_undone_skip_is_open(spark):
    df = rows(spark, (1, 1, "skipped", None), (2, 1, "undone", 1), (3, 2, "sent", None), (4, 2, "bounced", 3), (5, 3, "sent", None))
    assert [(r.uid, r.status) for r in ledger.current_decision(df).collect()] == [(3, "sent")]
    assert {r.uid for r in ledger.was_contacted(df).collect()} == {3}
    assert {r.uid for r in ledger.decided(df).collect()} == {2, 3}
    assert {r.id for r in ledger.reported_mails(df).collect()} == {3, 5} and {r.id for r in ledger.logged_mails(df).collect()} == {5}


def test_append_refuses_unknown_statuses(spark):
    kept, refused = ledger.append(rows(spark, (7, 1, "sent", None)), rows(spark, (0, 2, "skipped", None), (0, 3, "odd", None)).drop("id"))
    assert {r.id for r in kept.collect()} == {7, 8} and [r.uid for r in refused.collect()] == [3]


@pytest.mark.parametrize(("day", "counts"), [(-1, 0), (0, 1), (21, 1), (22, 0)])
def test_response_window_includes_both_ends(spark, day, counts):
    mails = rows(spark, (1, 1, "sent", None))
    at = (DAY + datetime.timedelta(days=1 + day)).replace(hour=1)
    answers = spark.createDataFrame([(1, at, None)], "uid long, started_at timestamp, completed_at timestamp")
    out = report.report(mails, spark.createDataFrame([], "uid long"), answers).first()
    assert (out.sent, out.started, out.completed, out.frame_version) == (1, counts, 0, "-")


def test_merged_responses(spark):
    at = lambda d: datetime.datetime(2026, 3, d)
    raw = spark.createDataFrame([(" ab ", None, at(5)), ("AB", at(3), at(4)), ("", at(1), None), (None, at(1), None)], "tag string, started timestamp, completed timestamp")
    assert [tuple(r) for r in report.merged_responses(raw).collect()] == [("AB", at(3), at(5))]


def test_wilson(spark):
    low, high = report.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b"), report.wilson(F.lit(0), F.lit(0))[0].alias("c"), report.rate_text(F.lit(0), F.lit(0)).alias("d")).first()
    assert (round(r.a, 4), round(r.b, 4), r.c, r.d) == (0.2366, 0.7634, 0.0, "–")


SETTING = eligibility.Setting("g", "p", ("a", "b"), None, 5)


def pool(spark, **more):
    tables = {
        "companies": ([(1, 1, None), (2, 1, None), (3, 2, "property only"), (4, 2, None)], "uid long, municipality int, screen_reason string"),
        "scores": ([(1, "g", "p", "a", None, 9), (1, "g", "p", "b", None, 3), (2, "g", "p", "a", "c", 9), (3, "g", "p", "a", None, 9), (4, "g", "p", "b", None, 5)], "uid long, goal string, prompt string, model string, criteria string, score int"),
        "seen": ([], "uid long, run_id string, batch_no int"),
        "results": ([], "uid long, run_id string, recommendation string, error_kind string"),
        "ledger": ([], "id long, uid long, status string, reverses long"),
        "suppression": ([], "uid long"),
    }
    return {k: spark.createDataFrame(more.get(k, data), schema) for k, (data, schema) in tables.items()}


@pytest.mark.parametrize(
    ("more", "uids"),
    [
        ({}, {1, 4}),
        ({"seen": [(1, "r", 1)]}, {4}),
        ({"seen": [(1, "other", 1)]}, {4}),
        ({"seen": [(1, "other", 1)], "results": [(1, "other", None, "fetch")]}, {1, 4}),
        ({"seen": [(1, "other", 1)], "results": [(1, "other", None, "interrupted")]}, {4}),
        ({"seen": [(1, "other", 1)], "results": [(1, "other", None, "fetch"), (1, "third", "send", None)]}, {4}),
        ({"seen": [(1, "r", 1)], "results": [(1, "r", None, "fetch")]}, {4}),
        ({"ledger": [(1, 1, "undone", None)]}, {4}),
        ({"suppression": [(4,)]}, {1}),
    ],
)
def test_eligibility(spark, more, uids):
    assert {r.uid for r in eligibility.drawable(pool(spark, **more), SETTING, "r").collect()} == uids


def test_null_criteria_fit_null_only(spark):
    assert {r.uid for r in eligibility.best_scores(pool(spark)["scores"], SETTING).collect()} == {1, 3, 4}


def test_recorded_batches_are_drawn_again(spark):
    t = pool(spark, seen=[(2, "r", 1)])
    assert [r.uid for r in eligibility.draw_batch(t, SETTING, "r", 1, 5, "s").collect()] == [2]
    assert [r.uid for r in eligibility.draw_batch(t, SETTING, "r", 2, 1, "s").collect()] == [1]


def test_standing(spark):
    r = eligibility.standing(pool(spark), SETTING).first()
    assert (r.pooled, r.kept, r.current, r.earlier_criteria, r.unscored, r.best, r.clear, r.drawable) == (4, 3, 2, 1, 0, 9, 2, 2)


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    got = lambda df: sorted((r.k, r.v or "") for r in df.collect())
    assert got(upsert.upsert(t, new, ["k"])) == [(1, "a"), (2, ""), (3, "c")]
    assert got(upsert.insert_or_ignore(t, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert got(upsert.upsert_keeping(t, new, ["k"], ["v"])) == [(1, "a"), (2, "b"), (3, "c")]


def test_versions_are_switched_and_old_ones_go(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    upsert.write_version(spark.range(3), root)
    upsert.write_version(spark.range(5), root)
    assert upsert.read_current(spark, root).count() == 5 and upsert.drop_old_versions(spark, root) == 1 and upsert.read_current(spark, root).count() == 5


def test_gazette_keeps_who_is_still_named(spark):
    said = [("a", 2, 1, True), ("a", 2, 2, False), ("b", 2, 3, True), ("b", 1, 4, False), ("c", 1, 5, False), ("c", 1, 6, False)]
    found = candidates.current_notices(spark.createDataFrame(said, "name string, published int, pos int, departed boolean"))
    assert sorted((r.name, r.pos) for r in found.collect()) == [("a", 2), ("c", 5)]


def test_site_dedupe_prefers_the_apex(spark):
    said = [(1, "u1", "de.m.ch", "m.ch"), (2, "u2", "www.m.ch", "m.ch"), (3, "u3", "x.ch", "x.ch")]
    found = candidates.dedupe_sites(spark.createDataFrame([(0, *x) for x in said], "q int, pos int, url string, host string, domain string"), ["q"])
    assert sorted((r.pos, r.url) for r in found.collect()) == [(1, "u2"), (3, "u3")]


def test_score_answers(spark):
    answers = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 2, 11), (4, 9, 3)], "pos int, uid long, score int")
    good, missing = candidates.validated_scores(answers, spark.createDataFrame([(1,), (2,), (3,)], "uid long"))
    assert [(r.uid, r.score) for r in good.collect()] == [(1, 5)] and {r.uid for r in missing.collect()} == {2, 3}


def test_stale_needs_age_and_no_decision(spark):
    day = datetime.datetime
    t = {
        "contacts": spark.createDataFrame([(u,) for u in (1, 2, 3, 4)], "uid long"), "drafts": spark.createDataFrame([(4, day(2026, 1, 1))], "uid long, created_at timestamp"),
        "searches": spark.createDataFrame([], "uid long, asked_at timestamp"), "seen": spark.createDataFrame([(1, day(2025, 1, 1)), (2, day(2026, 1, 1))], "uid long, drawn_at timestamp"), "ledger": rows(spark, (1, 3, "sent", None)),
        "profiles": spark.createDataFrame([(5,)], "uid long"), "sites": spark.createDataFrame([(2, "https://www.muster.ch/x")], "uid long, url string"),
    }
    assert {r.uid for r in retention.stale(t, datetime.date(2025, 6, 1)).collect()} == {1, 5}


def test_erasing_takes_the_pages_of_own_sites_only(spark):
    t = {n: spark.createDataFrame([(1,), (2,)], "uid long") for n in ("drafts", "searches", "responses", "progress")}
    t |= {
        "contacts": spark.createDataFrame([(1, "a@gmail.com", "third_party"), (1, "info@neu.ch", "generic"), (2, "b@x.ch", "seen")], "uid long, email string, email_kind string"), "sites": spark.createDataFrame([(1, "https://www.muster.ch/")], "uid long, url string"),
        "profiles": spark.createDataFrame([(2, "p")], "uid long, profile string"), "results": spark.createDataFrame([(1, "why"), (2, "why")], "uid long, reason string"),
        "ledger": spark.createDataFrame([(1, 1, "For Anna", "a@b.ch"), (2, 2, "For Urs", "u@b.ch")], "id long, uid long, subject string, address string"),
        "pages": spark.createDataFrame([("https://shop.muster.ch/a",), ("https://gmail.com/x",), ("https://neu.ch/b",), ("https://x.ch/",), (None,)], "url string"),
    }
    gone = spark.createDataFrame([(1,)], "uid long")
    left = retention.erase(t, gone, "forgotten")
    assert {r.url for r in left["pages"].collect()} == {"https://gmail.com/x", "https://x.ch/", None} and {r.uid for r in left["contacts"].collect()} == {2}
    assert {(r.uid, r.reason) for r in left["results"].collect()} == {(1, "forgotten"), (2, "why")} and {(r.subject, r.address) for r in left["ledger"].collect()} == {(None, None), ("For Urs", "u@b.ch")}
    assert {r.address for r in retention.erase(t, gone, clear_addresses=False)["ledger"].collect()} == {"a@b.ch", "u@b.ch"}
    assert {r.table_name: r.n for r in retention.erase_plan(t, gone).collect()} == {"contacts": 2, "drafts": 1, "profiles": 0, "sites": 1, "searches": 1, "responses": 1, "progress": 1, "pages": 2}


def test_streamed_decisions_match_the_batch(spark, tmp_path):
    said = [(1, 1, "skipped", None), (2, 1, "undone", 1), (3, 2, "sent", None), (4, 2, "bounced", 3), (5, 3, "sent", None), (6, 3, "never", None)]
    rows(spark, *said).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LEDGER).parquet(f"{tmp_path}/in")
    out = streams.run_to_end(streams.current_decisions(stream), spark, "decisions_now", f"{tmp_path}/ck")
    assert {r.uid: (r.id, r.status) for r in out.collect() if r.id is not None} == model(said)
