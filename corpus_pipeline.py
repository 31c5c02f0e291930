"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import stages
from shelfmark.llm.common import alone, table

STAGES = [
    ("quality classifier", stages.good_quality),
    ("near-duplicates", stages.one_of_each_group),
    ("benchmark decontamination", stages.no_benchmark),
    ("personal data", stages.no_personal_data),
    ("mix", stages.mixed),
]

# A trained classifier decides on the rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next one; what a stage left on its way is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
