"""Registered domains by the rules of a public suffix list: the longest rule that fits a host's last labels, wildcards and exceptions among them.

A rule `a.b` makes a.b a suffix, `*.a.b` every x.a.b, and `!x.a.b` takes x.a.b out again. A host's domain is its suffix and the label before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import urls

RULES = "suffix string, kind int, private boolean"
PLAIN, WILDCARD, EXCEPTION = 0, 1, 2
#: Rows of a list up to which it is broadcast.
MOST_BROADCAST = 50_000


def parsed(text: str, private: bool = False) -> list[tuple[str, int, bool]]:
    """suffix, kind and whether it is a private rule, of a list's text in the published format: a rule a line, // before remarks, and private rules between two marks.

    Rules of other scripts are there as written and in ASCII, as hosts come either way.
    """
    out = set()
    for line in text.splitlines():
        if line.startswith("//"):
            private = "BEGIN PRIVATE" in line or (private and "END PRIVATE" not in line)
            continue
        if not (rule := line.split(maxsplit=1)[0].lower() if line.strip() else ""):
            continue
        kind = EXCEPTION if rule[0] == "!" else WILDCARD if rule.startswith("*.") else PLAIN
        bare = rule.removeprefix("!").removeprefix("*.")
        forms = {bare}
        try:
            forms.add(bare.encode("idna").decode("ascii"))
        except UnicodeError:
            pass
        out |= {(form, kind, private) for form in forms}
    return sorted(out)


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rules of a list in a file that Spark can read, and the hosts of site builders, which the list lacks; without a path the short table of urls."""
    if path is None:
        rules = parsed("com\norg\nnet\nch\nde\nat\nfr\nit\nli\neu\nio\ninfo\nuk\nau\nnz\njp\nbr\n" + "\n".join(urls.SUFFIXES))
    else:
        rules = parsed("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return spark.createDataFrame(sorted({*rules, *parsed("\n".join(urls.BUILDERS), private=True)}), RULES)


def resolved(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, domain, suffix and private of each different host that isn't null.

    Every end of a host is looked up in rules (suffix, kind, private); exceptions go before others, longer suffixes before shorter ones. Where none fits, or nothing stands before the suffix, the
    domain is the host without www, as of an address or a made-up name, and suffix is null. Rules are broadcast if Spark says they are no more than MOST_BROADCAST.
    """
    each = hosts.where("host is not null").select("host").distinct().withColumn("bare", F.regexp_replace(F.lower(F.trim("host")), r"\.+$", "")).withColumn("labels", F.split("bare", r"\.", -1))
    ends = each.select("host", "labels", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("at", "end"))
    few = rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = ends.join((F.broadcast(rules) if few else rules).withColumnRenamed("suffix", "end"), "end")
    begins = F.col("at") + F.when(F.col("kind") == EXCEPTION, 1).when(F.col("kind") == WILDCARD, -1).otherwise(0)
    best = met.withColumn("begins", begins).where("begins >= 0").groupBy("host").agg(F.min(F.struct((F.col("kind") != EXCEPTION).alias("plain"), "begins", "private")).alias("x")).select("host", "x.begins", "x.private")
    out = each.join(best, "host", "left")
    tail = lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")
    named = F.coalesce(F.col("begins") > 0, F.lit(False))
    return out.select(
        "host", F.when(named, tail(F.greatest(F.col("begins"), F.lit(1)))).otherwise(F.regexp_replace("bare", r"^www\.", "")).alias("domain"),
        F.when(named, tail(F.col("begins") + 1)).alias("suffix"), (named & F.coalesce("private", F.lit(False))).alias("private"),
    )


def with_domain(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """rows with domain (null where the url has no host) and inbox_domain, where info@ may be guessed: the host, www aside, if it is a domain of its own and no customer's space."""
    rows = rows.withColumn("_host", F.nullif(urls.host(F.col(url)), F.lit("")))
    found = resolved(rows.select(F.col("_host").alias("host")), rules).withColumnsRenamed({"host": "_host", "domain": "_domain", "private": "_private"}).drop("suffix")
    bare = F.regexp_replace("_host", r"^www\.|\.+$", "")
    out = rows.join(found, "_host", "left")
    return out.withColumns({"domain": F.col("_domain"), "inbox_domain": F.when((bare == F.col("_domain")) & ~F.col("_private"), bare)}).drop("_host", "_domain", "_private")
