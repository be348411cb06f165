"""The corpus pipeline: quality, near duplicates, decontamination, mixing and token files, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagscope.llm import stages
from lagscope.llm.common import materialise, read

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("token_files", stages.token_files),
]

#: The model of the first stage and the vocabulary of the last are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes Parquet that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
