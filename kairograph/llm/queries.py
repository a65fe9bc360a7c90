"""Registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import brown_lm, decontaminate, exact_dedup, line_dedup, packing, phrases, quality_classifier, quality_rules, simhash, source_divergence, suffix_dedup, tokens, warc
from kairograph.llm.common import table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.split_and_score(spark, table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE).withColumnRenamed("id", "doc_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.quality_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), F.col("component").alias("component_id"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {
        "op1_brown_lm": op1_brown_lm,
        "op2_quality_rules": op2_quality_rules,
        "op3_line_dedup": op3_line_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_token_counts": op8_token_counts,
        "op9_simhash": op9_simhash,
        "op10_warc_zstd": op10_warc_zstd,
        "op11_phrases": op11_phrases,
        "op12_source_divergence": op12_source_divergence,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.ORACLE_SQL,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op5_decontaminate": decontaminate.ORACLE_SQL,
        "op11_phrases": phrases.ORACLE_SQL,
        "op12_source_divergence": source_divergence.ORACLE_SQL,
        "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    }
