"""The thin queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module of this package that has it as query().
MODULES = {
    "op8_suffix_array_dedup": "suffixes",
    "op10_html_extraction": "html",
    "op3_benchmark_decontamination": "decontaminate",
    "op2_secret_scans": "secrets",
    "op4_minhash_near_dedup": "neardup",
    "op9_toxicity": "toxicity",
    "op1_quality_classifier": "quality",
    "op6_packing": "packing",
    "op7_media_columns": "media",
    "op5_pii": "pii",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose module is imported when it runs, so that what one of them needs doesn't stop the others."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return import_module(f"inkwell.llm.{module}").query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(import_module("inkwell.llm.oracles").ORACLE_SQL)
