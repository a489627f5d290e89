"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

OPERATORS = {
    "op1_source_mix": "mix",
    "op2_uniform_shards": "shard",
    "op3_html_wrappers": "html",
    "op4_benchmark_decontamination": "decontam",
    "op5_quality_rules": "quality",
    "op6_toxicity": "toxicity",
    "op7_language_id": "langid",
    "op8_minhash_near_dedup": "neardup",
    "op9_lm_scoring": "lmscore",
    "op10_license_scan": "license",
}


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"plumbline.llm.{module}"), name) for name, module in OPERATORS.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {}
    for name, module in OPERATORS.items():
        if sql := getattr(importlib.import_module(f"plumbline.llm.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
