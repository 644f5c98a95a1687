"""Of a url's recorded answers that its SQL's order leaves tied, the first counts."""

from larkspur.plans import searches


def test_of_tied_answers_the_first_recorded_counts(spark, tmp_path):
    gone, fine = "x" * 13, "x" * 9  # answered with 404 and 200, both without a location
    rows = [(0, "https://a.example.com/", gone), (1, "https://a.example.com/", fine), (2, "https://b.example.com/", fine), (3, "https://b.example.com/", gone)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.url, r.status, r.error) for r in searches.q_redirects(spark, str(tmp_path)).collect()}
    assert found == {("https://a.example.com/", 404, "HTTP 404"), ("https://b.example.com/", 200, None)}
