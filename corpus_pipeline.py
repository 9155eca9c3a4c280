"""A training-data pipeline of five stages over documents.

1. quality_rules: documents that the weakly supervised rules reject go.
2. exact_dedup: of equal documents one stays.
3. simhash_near_dedup: of each group of near-duplicates one document stays.
4. secret_scan: secrets that the forest confirms are replaced in the texts; every document stays.
5. best_fit_packing: the documents are packed into sequences of 2048 tokens.

Each stage takes all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from estatelens.llm.common import read_table, written
from estatelens.llm.exact_dedup import drop_exact_copies
from estatelens.llm.packing import pack
from estatelens.llm.quality_rules import keep_good
from estatelens.llm.secret_scan import redact
from estatelens.llm.simhash import drop_near_copies


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, "source" if "source" in docs.columns else None, public_tokenizers.path("byte_bpe_50k.json"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each over what its predecessor wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
