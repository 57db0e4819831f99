"""The corpus pipeline: STAGES over `documents`, each applying one text operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
to the shared folder and reads again as the next stage's documents. All but the last return the
columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import stages
from fieldloom.llm._common import scratch, stored

STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("exact_dedup", stages.exact_dedup_stage),
    ("simhash_near_dedup", stages.simhash_stage),
    ("benchmark_decontamination", stages.decontamination_stage),
    ("source_mixing", stages.mixing_stage),
]

#: Neither the classifier nor the random rounding can be written in SQL; the tests hold every
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`. What a stage stores on its way goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            docs = stored(result, f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
