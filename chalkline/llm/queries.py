"""Registered queries of the training-data operators: op<N>_<name>(spark, sf_dir), with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import divergence, fingerprints, lattice, licenses, mixing, packing, prefix_trie, quality, secrets, simhash, substring_dedup, suffix_dedup, toxicity
from chalkline.llm.common import documents, materialize, row_hash, table, word_count


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_successors(documents(spark, sf_dir))


def op2_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash().alias("identity")), "sized")
    mixed = mixing.mix(sized, F.col("size"), F.col("identity"))
    shards = F.array_join(F.transform("mix_copies", lambda c: c["shard"].cast("string")), ",").alias("shards")
    return mixed.select("doc_id", "size", *[F.col(f"mix_{c}").alias(c) for c in ("source_size", "target", "taken")], shards)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("n_factors")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_lattice_score": op2_lattice_score,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_source_audit": op13_source_audit,
}

ORACLES: dict[str, str] = {
    "op7_substring_dedup": substring_dedup.ORACLE, "op8_quality_rules": quality.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_license_scan": licenses.ORACLE,
    "op13_source_audit": divergence.ORACLE,
}
