"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import common
from plinth.llm.mixing import mixing_stage
from plinth.llm.packing import packing_stage
from plinth.llm.quality_classifier import quality_stage
from plinth.llm.simhash import near_dedup_stage
from plinth.llm.suffix_dedup import dedup_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier, transitive links, repeated strings and packing aren't SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
