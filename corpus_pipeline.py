"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.stages import drop_common_lines, encode, keep_good, mix_sources, one_of_each_group
from postmill.session import shared_dir

STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_common_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
# Fingerprints, byte merges and a hash order that SQL in DuckDB has no functions for: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
