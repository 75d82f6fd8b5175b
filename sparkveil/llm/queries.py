"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_quality, op2_bpe, op3_urls, op4_decontamination, op5_chat, op6_toxicity, op7_ann, op8_substring, op9_secrets, op10_simhash, op11_fim, op12_token_counts, op13_repair

MODULES = [op1_quality, op2_bpe, op3_urls, op4_decontamination, op5_chat, op6_toxicity, op7_ann, op8_substring, op9_secrets, op10_simhash, op11_fim, op12_token_counts, op13_repair]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in vars(module).items() if name.startswith("op") and getattr(f, "__module__", "") == module.__name__}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
