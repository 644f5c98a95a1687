"""What is outside of the search over a folder's tables is stored once, not derived in each superstep."""

from larkspur.plans import searches


def test_answers_and_pages_are_read_from_what_is_stored(spark):
    _, out = searches.outside(spark, "/root/testdata/sf0.001", second=True)
    wanted = spark.createDataFrame([(1, "q0", "first"), (-1, "q0", "first")], "uid long, query string, provider string")
    asked, read = out.ask(wanted), out.read(spark.createDataFrame([(1, "none")], "uid long, url string"))
    for rows in (asked, read):
        assert rows.inputFiles() and all("/outside-" in f for f in rows.inputFiles())
    assert {r.uid for r in asked.collect()} == {1, -1} and read.count() == 0
