"""Queries of the operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, collocations, conversation_repair, decontaminate, link_graph, nbsvm, packing, quality_rules, secrets, simhash, suffix_dedup, token_files, toxicity
from .common import documents, remainder, staged_path


def vocabulary(name: str) -> str:
    return import_module("public_tokenizers").path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    return secrets.report(versions, secrets.advance(versions, secrets.empty_ledger(spark))).withColumnRenamed("path", "doc_id")


def secret_ledger_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in two rounds: a ledger of the base rules alone is saved, and the next run, with all rules, scans only what it lacks."""
    versions, path = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text"), staged_path(spark, "ledger")
    secrets.save(secrets.advance(versions, secrets.empty_ledger(spark), secrets.BASE), path)
    return secrets.report(versions, secrets.advance(versions, secrets.load(spark, path))).withColumnRenamed("path", "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token_files")
    token_files.write(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read(spark, path)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = nbsvm.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality_rules, op2_secret_ledger, op3_suffix_dedup, op4_link_graph, op5_token_files, op6_decontamination, op7_quality_classifier, op8_language_model, op9_packing, op10_simhash, op11_collocations, op12_toxicity, op13_conversation_repair, secret_ledger_rounds)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_ledger": secrets.oracle(), "secret_ledger_rounds": secrets.oracle(), "op3_suffix_dedup": suffix_dedup.oracle(), "op11_collocations": collocations.oracle(), "op13_conversation_repair": conversation_repair.oracle()}
