"""Documents through five stages, each written as Parquet and read again by the next.

toxicity (toxic documents go), quality_rules (poor ones go), near_dedup (one of each group stays), decontaminate (those
with a benchmark passage go), sentencepiece (what stays is encoded, and decoded again as a check).

Every stage takes rows with nulls in any column, extra columns whatever their names, and empty tables (which stay empty).
Null, empty and short texts go with the quality rules (fewer than 50 words); a null doc_id is no reason to go. Repeated rows and
copies, also under one doc_id, become one row in near_dedup. Very long texts go whole through all stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import common as C
from emberlog.llm import decontaminate, minhash_dedup, quality_rules, sentencepiece_lattice, toxicity


def lean(stage):
    """A stage that begins with small heaps: executors outlive stages and would add what the earlier ones needed to its own.

    So does its last job, which the caller runs: sentencepiece needs the heap for its relations first and Python for its ids then.
    """

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.release_heaps(spark)
        found = stage(spark, docs, sf_dir)
        C.release_heaps(spark)
        return found

    return begun


@lean
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.cleaned(docs, C.table(spark, sf_dir, "labels"))


@lean
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, C.table(spark, sf_dir, "labels"))


@lean
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicated(docs)


@lean
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, C.table(spark, sf_dir, "benchmark"))


@lean
def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_lattice.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Learned scores, components of a similarity graph and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), set(C.WRITTEN)
    for name, stage in STAGES:
        docs = C.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        C.clean(spark, before, [docs])  # what the stage read and wrote beside its result is not needed any more
    return docs
