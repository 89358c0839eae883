"""Attachment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attachment_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """``path, name, n_bytes, content`` of the files under a glob. The bytes are read only where they are used."""
    files = spark.read.format("binaryFile").load(path_glob)
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("n_bytes"), "content"
    )
