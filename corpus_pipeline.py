"""The corpus pipeline: quality rules, near duplicates, repeated strings, secrets, packing.

Each stage works on all that its predecessor kept; stages exchange Parquet tables in the shared folder.
SQL can't express an isolation forest, so there is no ORACLE_SQL; tests/llm compares the stages with
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import stages
from caseflow.llm._common import read, stash

STAGES = [
    ("quality_rules", stages.drop_low_quality),
    ("ngram_join", stages.drop_near_duplicates),
    ("suffix_dedup", stages.cut_repeats),
    ("secret_scan", stages.redact_secrets),
    ("packing", stages.pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
