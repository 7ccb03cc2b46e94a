"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, lines, lm, mixing, quality, repeats, secrets, tokens
from .shared import documents


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(spark, documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(documents(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(documents(spark, sf_dir))


def op9_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_mix_sources": op2_mix_sources,
    "op3_class_lm": op3_class_lm,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_main_text": op6_main_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_byte_repeats": op9_byte_repeats,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": mixing.SQL,
    "op4_line_dedup": lines.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_main_text": html.SQL,
    "op7_quality_rules": quality.SQL,
    "op8_jaccard_join": jaccard.SQL,
    "op9_byte_repeats": repeats.SQL,
    "op10_secret_scan": secrets.SQL,
}
