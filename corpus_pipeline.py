"""Corpus pipeline: five stages, each on what its predecessor kept.

``run`` applies them to ``documents``; every stage's rows are written as
Parquet in the shared folder and read again, so each starts from a table.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from vigil.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity  # noqa: E402
from vigil.llm.common import documents, write_table  # noqa: E402

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: Trained scores and the packing order cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents that the stages keep."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
