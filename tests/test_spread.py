"""Work on rows is dealt out over all tasks, however few row groups a file has, and does the same."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.functions import html
from larkspur.plans.catalogue import QUERIES

PAGE = '<title>T</title><main>Hallo <a href="/impressum">Recht</a> <a href="/team">Wir</a></main><footer>Weg 1</footer><script type="application/ld+json">{"@type": "Organization", "name": "Muster"}</script>'


def test_a_page_is_parsed_once(monkeypatch):
    calls, read = [], html.read
    monkeypatch.setattr(html, "read", lambda x: calls.append(x) or read(x))
    found = html.page_parts.func(pd.Series([PAGE, None]), pd.Series(["https://muster.ch/", None]))
    assert len(calls) == 2
    monkeypatch.undo()
    assert found["said"].tolist() == [html.page_text(PAGE), None]
    assert found["organisation"].tolist() == [html.organisations(PAGE), None] == ["Name: Muster", None]
    assert tuple(found.loc[0, ["imprint", "legal", "about"]]) == html.ranked_links(PAGE, "https://muster.ch/")
    assert found.loc[1, "imprint"] == []


@pytest.mark.parametrize("name", ["q_page_text", "q_textify"])
def test_parsing_of_one_row_group_has_all_tasks(spark, tmp_path, name):
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).select(F.col("id").alias("page_id"), F.lit("https://a.ch/").alias("url"), F.lit(PAGE).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_sentence_problems_of_one_row_group_have_all_tasks(spark, tmp_path):
    words = ["Leiter", "Halbleiter", "HALBLEITERIN", "Leiterinnen", "Leitern", "xLeiter_", "Stromleiter Chef", "Ableiter-Chefin", "Wärmeleiter", "CEO", "the the", "the AND", "thé and", "we_ is", "a@b", "a@b.ch", "wwW.x"]
    spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["q_sentence_problems"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1
    has = lambda p: [words[r.doc_id] for r in found.orderBy("doc_id").collect() if p in r.problems.split(",")]
    assert has("role_noun") == ["Leiter", "HALBLEITERIN", "Leiterinnen", "Stromleiter Chef", "Ableiter-Chefin", "CEO"]
    assert has("english") == ["the AND"]
    assert has("email") == ["a@b.ch"]
