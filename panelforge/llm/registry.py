"""Queries of the corpus operators and the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, html_extract, mixing, ngram_join, pii, quality, sharding, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_pii": pii.op4_pii,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.SQL,
    "op5_sharding": sharding.SQL,
    "op7_decontamination": decontam.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
