"""Corpus pipeline: five operators over ``documents``, each stage written as
Parquet to the shared scratch folder and read back as the next one's input.

Order: quality rules, SimHash near-dedup, benchmark decontamination, personal
data, byte-level BPE. Stages before the last return the columns of their input
(rows that a stage rejects go, personal data is masked in ``text``); the last
returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Empty input gives
empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martlet.llm import bpe, decontaminate, pii, quality_rules, simhash
from martlet.llm.common import materialise, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("byte_bpe", bpe.stage),
]

#: Robust scatter, fingerprints and span training are beyond SQL; tests compare
#: the pipeline with a plain single-process version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
