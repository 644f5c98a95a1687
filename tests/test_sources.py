import datetime
import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import decisions
from larkspur.plans import run
from larkspur.sources import files
from larkspur.streaming import decisions as streams

from .test_operators import SETTING, pool


def test_register_answers(spark, tmp_path):
    v = lambda x: {"type": "literal", "value": x}
    rows = [{"uid": v("CHE109322551"), "name": v("Muster AG"), "lf": v("0106"), "desc": v("Herstellung. Die Gesellschaft kann alles.")}, {"uid": v("CHE-109.322.551"), "name": v("X GmbH in Liquidation"), "lf": v("0107")}]
    (tmp_path / "a.json").write_text(json.dumps({"head": {}, "results": {"bindings": rows}}))
    found = sorted(files.register_companies(spark, str(tmp_path)).collect(), key=lambda r: r.name)
    assert [(r.purpose_head, r.screen_reason, r.street) for r in found] == [("Herstellung.", None, None), ("", "in liquidation", None)] and {r.uid for r in found} == {"CHE109322551"}


def test_response_lines(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿uid,started_at,completed_at\nCHE1,2026-03-01 10:00:00,\nCHE2,nonsense,\n", encoding="utf-8")
    good, bad = files.responses_csv(spark, str(path))
    assert [(r.tag, r.started) for r in good.collect()] == [("CHE1", datetime.datetime(2026, 3, 1, 10))] and [r.tag for r in bad.collect()] == ["CHE2"]
    path.write_text("uid,x\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        files.responses_csv(spark, str(path))


def test_response_bodies(spark):
    body = json.dumps([{"tag": "a", "started_at": "2026-03-01T10:00:00", "completed_at": None}])
    assert files.responses_json(spark.createDataFrame([(body,)], "body string")).first().tag == "a"


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\nA.ch  # x\n\nb.ch\na.ch\n")
    assert {r.entry for r in files.list_file(spark, str(tmp_path / "l.txt")).collect()} == {"a.ch", "b.ch"}
    (tmp_path / "t.md").write_text("| date | UID | c | p | decision | reason |\n|-|-|-|-|-|-|\n| 2026-01-02 | CHE-109.322.551 | M | A | Sent | ok |\n| 2026-01-03 | CHE-000.000.000 | N | B | Skipped | no |\n")
    known, unknown = files.earlier_decisions(spark.createDataFrame([("CHE109322551",)], "uid string"), files.table_rows(spark, str(tmp_path / "t.md")))
    assert [(r.uid, r.status) for r in known.collect()] == [("CHE109322551", "sent")] and unknown.count() == 1


def test_notices(spark, tmp_path):
    (tmp_path / "n.xml").write_text("<r><meta><publicationNumber>N1</publicationNumber><publicationDate>2026-02-03T00:00:00</publicationDate></meta><content><publicationText>Muster AG, CHE-109.322.551</publicationText></content></r>")
    found = files.usable_notices(files.notices_xml(spark, str(tmp_path)), "CHE109322551").collect()
    assert [(r.number, r.published) for r in found] == [("N1", datetime.date(2026, 2, 3))]


def test_search_answers(spark):
    rows = [("q", "a", [], ["x", "y"], None), ("q", "b", [("u", "t", "s")], [], None), ("e", "a", [], [], None), ("e", "b", [("u", "t", "s")], [], None), ("f", "a", None, None, "timeout")]
    df = spark.createDataFrame(rows, "query string, provider string, results array<struct<url: string, title: string, snippet: string>>, unresponsive array<string>, error string")
    found = {r.query: r.provider for r in files.settled_answers(df, ["a", "b"], ["x", "y"]).collect()}
    assert found == {"q": "b", "e": "a"}  # silence of all engines isn't an answer; emptiness is


@pytest.mark.parametrize(("host", "unsafe"), [("127.0.0.1", True), ("10.1.2.3", True), ("172.20.0.1", True), ("8.8.8.8", False), ("999.1.1", False), ("localhost", True), ("muster.ch", False), ("169.254.1.1", True)])
def test_unsafe_addresses(spark, host, unsafe):
    assert spark.createDataFrame([(host,)], "h string").select(files.unsafe_address(F.col("h")).alias("x")).first().x is unsafe


def test_verdicts(spark):
    c = F.col
    rows = [(None, None, None, None, None), ("s", None, None, None, None), ("s", "Anna", None, None, "shab"), ("s", "Anna", "a@b.ch", "seen", "site"), ("s", None, "a@b.ch", "third_party", "site")]
    df = spark.createDataFrame(rows, "site string, name string, email string, kind string, source string")
    no = F.lit(False)
    said = [r.v.recommendation for r in df.select(decisions.recommend(c("site"), no, no, c("name"), c("email"), c("kind"), c("source")).alias("v")).collect()]
    assert said == ["skip", "hold", "hold", "send", "hold"]


def test_send_blocks_keep_three_states_apart(spark):
    base = {"decided": False, "suppressed": False, "body": "x", "old_frame": False, "email": "a@b.ch", "drifted": False, "approved": True, "placeholder_link": False, "foreign_link": False}
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean'}" for k, v in base.items()) + ", problems array<string>"
    for problems, why in ((None, "unchecked"), ([], None), (["x"], "failed")):
        assert decisions.send_block(spark.createDataFrame([(*base.values(), problems)], kinds)).first().blocked == why


def test_providers_fail_row_by_row(spark):
    def ask(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    found = {r.key: (r.value, r.error_kind) for r in run.ask_each(spark.createDataFrame([(1, "ok"), (2, "bad")], "key int, prompt string"), ask).collect()}
    assert found == {"1": ("OK", None), "2": (None, "ValueError")}


def test_run_loop_stops_at_its_target(spark, tmp_path):
    told = []
    enrich = lambda uids: uids.select("uid", F.lit("send").alias("recommendation"), F.lit(None).cast("string").alias("error_kind"))
    t = run.run_batches(pool(spark), SETTING, "r", enrich, target=2, size=1, most=5, seed="s", root=f"file://{tmp_path}", done=lambda k, r: told.append((k, r.count())))
    assert {r.uid for r in t["results"].collect()} == {1, 4} and {(r.uid, r.batch_no) for r in t["seen"].collect()} == {(1, 1), (4, 2)} and told == [(1, 1), (2, 1)]


def test_streamed_answers_in_time(spark, tmp_path):
    at = lambda d, h=9: datetime.datetime(2026, 3, d, h)
    spark.createDataFrame([(1, 10, at(2))], "uid long, id long, sent_at timestamp").write.parquet(f"{tmp_path}/m")
    spark.createDataFrame([(1, at(1)), (1, at(2, 1)), (1, at(23)), (1, at(24)), (2, at(3))], "uid long, answered_at timestamp").write.parquet(f"{tmp_path}/r")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    out = streams.run_to_end(streams.answers_in_time(read("m", "uid long, id long, sent_at timestamp"), read("r", "uid long, answered_at timestamp")), spark, "answers_now", f"{tmp_path}/ck", "append")
    assert {r.answered_at for r in out.collect()} == {at(2, 1), at(23)}


def test_a_run_that_broke_off_asks_nothing_twice(spark, tmp_path):
    asked, root = [], f"file://{tmp_path}"

    def enrich(uids):
        found = [r.uid for r in uids.collect()]
        asked.extend(found)
        return spark.createDataFrame([(u, "send", None, None, None) for u in found], "uid long, recommendation string, error_kind string, finished_at timestamp, needs_js int")

    def go(tables, target):
        t = run.run_batches(tables, SETTING, "r", enrich, target=target, size=1, most=5, seed="s", root=root)
        return t, sorted((r.uid, r.recommendation) for r in t["results"].where("run_id = 'r'").collect())

    tables, first = go(pool(spark), 1)
    before = list(asked)
    assert first and len(before) == len(set(before))
    _, again = go(tables, 1)  # from the tables that it gave
    assert again == first and asked == before
    _, anew = go(pool(spark), 1)  # from those it began with
    assert anew == first and asked == before
    _, more = go(tables, 2)
    assert set(first) < set(more) and len(asked) == len(set(asked)) > len(before)
    _, all_anew = go(pool(spark), 2)
    assert all_anew == more and len(asked) == len(set(asked))


def test_a_batch_that_broke_off_is_made_whole(spark, tmp_path):
    (tmp_path / "r" / "results-1").mkdir(parents=True)
    (tmp_path / "r" / "results-1" / "part-0.parquet").write_bytes(b"half a file")
    enrich = lambda uids: uids.select("uid", F.lit("send").alias("recommendation"), F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("int").alias("needs_js"))
    t = run.run_batches(pool(spark), SETTING, "r", enrich, target=1, size=1, most=5, seed="s", root=f"file://{tmp_path}")
    assert t["results"].where("run_id = 'r' and recommendation = 'send'").count() == 1
