"""The corpus pipeline: stages over the documents table, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewarden.llm import stages
from gatewarden.llm.common import saved, table

STAGES = [
    ("quality", stages.keep_good),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("decontamination", stages.remove_benchmark_passages),
    ("pii", stages.mask_personal_data),
    ("packing", stages.pack),
]

#: The classifier, the tokenizer and the packing have no SQL form; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
