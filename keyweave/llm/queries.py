"""The queries of this package by name; the driver's entry adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyweave.catalog.base import Query
from keyweave.llm import (
    chat,
    decontamination,
    divergence,
    imatch,
    langid,
    licenses,
    packing,
    quality,
    runs,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from keyweave.llm.columns import table
from keyweave.llm.oracles import chat_sql, divergence_sql, imatch_sql, quality_sql


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counts_by_limit(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.toxicity_of_documents(docs, labels)


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages_of_documents(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_of_documents(table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.contamination_of_documents(docs, benchmark)


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards_of_documents(table(spark, folder, "documents"))


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digests(spark, table(spark, folder, "conversations"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def op12_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash": Query(op1_simhash),
    "op2_token_counts": Query(op2_token_counts),
    "op3_toxicity": Query(op3_toxicity),
    "op4_license_scans": Query(op4_license_scans),
    "op5_language_id": Query(op5_language_id),
    "op6_packing": Query(op6_packing),
    "op7_quality_rules": Query(op7_quality_rules, quality_sql()),
    "op8_benchmark_decontamination": Query(op8_benchmark_decontamination),
    "op9_sharding": Query(op9_sharding),
    "op10_chat_formatting": Query(op10_chat_formatting, chat_sql()),
    "op11_source_divergence": Query(op11_source_divergence, divergence_sql()),
    "op12_document_fingerprints": Query(op12_document_fingerprints, imatch_sql()),
    "op13_periodic_runs": Query(op13_periodic_runs),
}
