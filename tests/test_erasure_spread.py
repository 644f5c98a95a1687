"""Pages meet the erased domains in many tasks, even if all of them are of one domain."""

from pyspark.sql import functions as F

from larkspur.operators import retention


def test_pages_of_one_domain_are_dealt_out(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(200).select(F.concat(F.lit("https://www.muster.ch/"), "id").alias("url"), F.lit("x").alias("html")).union(spark.sql("select null as url, 'y' as html union all select 'https://b.ch/', 'z'"))
        domains = spark.createDataFrame([("muster.ch",), ("c.ch",)], "domain string")
        gone = retention._of_domains(pages, domains, "left_semi")
        assert gone.count() == 200 and sum(1 for x in gone.rdd.glom().collect() if x) > 1
        assert sorted(r.html for r in retention._of_domains(pages, domains, "left_anti").collect()) == ["y", "z"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
