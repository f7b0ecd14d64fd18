"""Registered queries of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from issueforge.llm import align, chat, decontaminate, line_dedup, lm, near_dup, packing, pii, quality, repeats, spelling, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_components(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc32(packing.pack(_table(spark, sf_dir, "documents")))


def op10_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(_table(spark, sf_dir, "documents"))


def op8_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), least=line_dedup.EVERY_LINE)


def op6_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.format_conversations(rows))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_strings(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.cross_tokenizer_alignment(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_templates": op1_url_templates,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op3_chat_windows": op3_chat_windows,
    "op9_personal_data": op9_personal_data,
    "op6_robust_quality": op6_robust_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity_severity": op8_toxicity_severity,
    "op10_pitman_yor_lm": op10_pitman_yor_lm,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_repeats": op13_suffix_repeats,
}

ORACLE: dict[str, str] = {}
