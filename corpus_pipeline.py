"""Corpus preparation: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coogrid.llm.language import language_stage
from coogrid.llm.packing import packing_stage
from coogrid.llm.pii import pii_stage
from coogrid.llm.simhash import simhash_stage
from coogrid.llm.toxicity import toxicity_stage
from coogrid.plans.durable import drop_path, scratch_path

#: Name and function (spark, docs, sf_dir) of each stage, in order.
STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", simhash_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

#: Compression, learning and tokenizing are not expressible in SQL; tests compare with plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the table of a stage goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
