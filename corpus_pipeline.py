"""Clean a corpus: toxic documents go, one of each near-duplicate group stays, benchmark passages go, personal data is masked, and
what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reflexgrid.llm import stages
from reflexgrid.llm.common import drop, table, written

STAGES = stages.STAGES

ORACLE_SQL = None  # trained models, tokenizers and edit distances: tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
