"""What a run is set up with, and what is done on the driver."""

import json
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ledger, lifecycle, review
from larkspur.plans import run
from larkspur.sources import setup


def test_profile(tmp_path):
    path = tmp_path / "profile.toml"
    path.write_text('goal = " find firms "\nsurvey_url = "https://s.example"\n[sender]\nname = "Mia Groß"\naffiliation = "HS"\n')
    found = setup.load_profile(str(path), {"sender": {"name", "affiliation", "school_short"}})
    assert found["goal"] == "find firms" and setup.drafting_gaps(found) == ["sender.school_short", "invitation.topic"] and setup.eszett_fields(found) == ["sender.name"]
    for wrong in ("goal = 1 2", 'about_me = "x"', 'goal = "x"\nnonsense = 1', 'goal = "x"\nsurvey_url = "http://s"'):
        path.write_text(wrong)
        with pytest.raises(setup.SetupError):
            setup.load_profile(str(path))


def test_prompts(tmp_path):
    (tmp_path / "score.md").write_text("---\nversion: v3\n---\nJudge $name.\n")
    assert setup.rendered(str(tmp_path), "score", name="Muster") == ("v3", "Judge Muster.")
    for name, text in (("a", "no header"), ("b", "---\nother: 1\n---\nx"), ("c", "---\nversion: 1\n---\n$missing")):
        (tmp_path / f"{name}.md").write_text(text)
        with pytest.raises(setup.SetupError):
            setup.rendered(str(tmp_path), name)
    said = setup.as_data("a <<<<END b", url="https://x")
    (nonce,) = set(re.findall(r"(?:PAGE|END)-([0-9a-f]{16})", said))
    assert said.count("<<<") == 2 and said.endswith(f"<<<END-{nonce}>>>") and " url=https://x>>>" in said


def test_register_is_read_page_by_page(spark, tmp_path):
    asked = []

    def ask(size, offset):
        asked.append(offset)
        return [{"uid": k} for k in range(offset, min(offset + size, 5))]

    assert sorted(r.uid for r in setup.register(spark, ask, 2, f"file://{tmp_path}/r", "uid long").collect()) == [0, 1, 2, 3, 4] and asked == [0, 2, 4]
    with pytest.raises(setup.SetupError):
        setup.register(spark, lambda size, offset: [], 2, f"file://{tmp_path}/none", "uid long")
    query = setup.register_query("https://g", {"s": "https://s/"}, {"uid": "s:id", "lf": "s:type"}, {"street": "s:address/s:street"}, ["https://f/1", "https://f/2"], "lf", 10, 20)
    assert "OPTIONAL { ?c s:address/s:street ?street }" in query and "FILTER(?lf IN (<https://f/1>, <https://f/2>))" in query and query.endswith("ORDER BY ?uid LIMIT 10 OFFSET 20")


def test_schemas_manifest_and_health(spark, tmp_path):
    old = spark.createDataFrame([("7", "x")], "id string, more string")
    assert setup.migrated(old, "id long, name string").first().asDict() == {"id": 7, "name": None, "more": "x"}
    assert setup.empty_tables(spark, {"a": "id long"})["a"].count() == 0
    said = json.loads(setup.manifest("r1", {"goal": "secret"}, {"score": "v3"}, str(tmp_path), size=20))
    assert said["run_id"] == "r1" and said["settings"] == {"size": 20} and "secret" not in json.dumps(said)
    assert setup.health({"fine": lambda: "ok", "bad": lambda: 1 / 0}) == [("fine", True, "ok"), ("bad", False, "ZeroDivisionError: division by zero")]


def test_providers_are_asked_again_only_where_it_may_help(spark):
    def ask(prompt):
        raise {"t": TimeoutError, "v": ValueError}[prompt]("no")

    rows = spark.createDataFrame([("1", "t"), ("2", "v")], "key string, prompt string")
    found = {r.key: r.error_kind for r in run.ask_each(rows, ask, retries=1, wait=0.01, passing=run.PASSING).collect()}
    assert found == {"1": "TimeoutError", "2": "ValueError"}


def test_rows_are_numbered_without_one_task(spark):
    rows = spark.range(50).withColumn("k", F.col("id") % 7)
    found = ledger.numbered(rows, {"k": -F.col("k")}, ["id"], "n").orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 51)) and [(-r.k, r.id) for r in found] == sorted((-r.k, r.id) for r in found)


def test_codes_and_addresses(spark):
    code = lifecycle.new_code({"AAAAAA"})
    assert len(code) == 6 and set(code) <= set(lifecycle.CODE_LETTERS)
    rows = spark.createDataFrame([("a@x.ch", "seen", [("a@x.ch", "seen"), ("info@x.ch", "generic")])], "email string, email_kind string, addresses array<struct<email: string, kind: string>>")
    found = review.readdressed(rows, F.lit("info@x.ch")).first()
    assert (found.email, found.email_kind, [a.email for a in found.addresses]) == ("info@x.ch", "generic", ["info@x.ch", "a@x.ch"]) and review.readdressed(rows, F.lit("no@x.ch")).first().email == "a@x.ch"
