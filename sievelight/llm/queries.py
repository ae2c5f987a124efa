"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import chat, decontaminate, licenses, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, secrets, substring_dedup
from sievelight.llm.common import read


def _documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _documents(quality_rules.op1_quality_rules),
        "op2_lm_scoring": _documents(lm_scoring.op2_lm_scoring),
        "op3_decontamination": lambda spark, sf_dir: decontaminate.op3_decontamination(
            read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
        ),
        "op4_license_scans": _documents(licenses.op4_license_scans),
        "op5_chat_formatting": lambda spark, sf_dir: chat.op5_chat_formatting(read(spark, sf_dir, "conversations")),
        "op6_secret_scans": _documents(secrets.op6_secret_scans),
        "op7_substring_dedup": _documents(substring_dedup.op7_substring_dedup),
        "op8_mixing": _documents(mixing.op8_mixing),
        "op9_quality_classifier": lambda spark, sf_dir: quality_classifier.op9_quality_classifier(
            read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
        ),
        "op10_near_dedup": _documents(near_dedup.op10_near_dedup),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op5_chat_formatting": chat.ORACLE,
        "op7_substring_dedup": substring_dedup.ORACLE,
        "op8_mixing": mixing.ORACLE,
    }
