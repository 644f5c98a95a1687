"""A training-data pipeline over documents: rejection by quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents; the last returns places in sequences of 2048 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, nbsvm, packing, secrets, simhash
from larkspur.llm.common import documents, staged
from larkspur.llm.queries import vocabulary

#: Fitted models, components over all rows and sequences have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labelled ones among docs, doesn't reject."""
    return nbsvm.score(docs, nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose shingles of five words have 0.8 or more in common, the row of the smallest doc_id, once; of texts that share it, that of the least hash.

    Texts of one doc_id that aren't alike are in groups of their own. Rows without a doc_id stay.
    """
    found = simhash.similar_groups(docs, similarity=0.8, width=5)
    first = found.where("component_id = doc_id and component_version = version").select("doc_id", F.col("version").alias("_version"))
    kept = docs.withColumn("_version", _version()).join(first, ["doc_id", "_version"], "left_semi").dropDuplicates(["doc_id", "_version"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; of texts that share a doc_id, each is judged by itself. Rows without a doc_id stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.contaminated(docs, items, versions=True).select("doc_id", F.col("version").alias("_version")).distinct()
    return docs.withColumn("_version", _version()).join(leaks, ["doc_id", "_version"], "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of each secret."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    return secrets.redacted(docs, secrets.advance(versions, secrets.empty_ledger(spark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each text in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
