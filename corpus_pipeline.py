"""The corpus pipeline: stages that each apply one operator to what the stage before it kept.

All stages but the last return the columns of their input: toxic documents go, one document of each group of near
duplicates stays, contaminated documents go, and documents are repeated so that expected domain tokens reach their
targets (no document is lost: rates are one at least, unless another floor is given). The last adds shard and slot.

Every stage takes null and empty texts, null ids, repeated rows, empty tables and further columns of any name: texts that
are null or without words are neither toxic nor near duplicates nor contaminated, rows without an id stay, and each of
several equal rows is treated alike. Rows that share an id are one document for the second and third stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontam, mixing, ngram_join, sharding, toxicity
from panelforge.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, float] | None = None, floor: float = 1.0, copy_col: str | None = None) -> DataFrame:
    """Target weights by domain, the least rate, and a column for the number of a copy are the caller's choice; the
    pipeline keeps the columns of its input and drops no document."""
    return mixing.mixed(docs, mixing.trained(docs, table(spark, sf_dir, "labels")), weights, floor=floor, copy_col=copy_col)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("sharding", shard),
]
#: Models are fitted on the way, which SQL can't express; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
