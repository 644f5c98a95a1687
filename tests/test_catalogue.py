"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.plans.catalogue import QUERIES, SQL
from larkspur.sources.driver_tables import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DIR).toPandas()
    if name not in SQL:
        assert len(found)
        return
    con = duckdb.connect()
    for t in (*TABLES, "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    expected = con.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)


def test_sentence_problems_of_whole_texts(spark, tmp_path):
    filler = "wort " * 40
    said = {1: filler + "im Jahr 1999", 2: filler + "an a@b.ch", 3: filler + "sehr innovativ", 4: "kurz", 5: "x" * 160, 6: filler}
    spark.createDataFrame(list(said.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: set(r.problems.split(",")) - {""} for r in QUERIES["q_sentence_problems"](spark, str(tmp_path)).collect()}
    assert found == {1: {"too_long", "year"}, 2: {"too_long", "email"}, 3: {"too_long", "banned_word"}, 4: set(), 5: {"too_long"}, 6: {"too_long"}}


def plain(df: pd.DataFrame) -> list[str]:
    """The rows, in an order of their own, with numbers and absent values written alike whatever their types."""

    def value(v: object) -> str:
        return "null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(str([value(v) for v in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
