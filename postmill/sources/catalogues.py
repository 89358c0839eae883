"""Catalogue files: one per language, a key and its text per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.catalogue import latest_translations

# An entry of a catalogue file, and the language in the file's name.
ENTRY = r"""^\s*\$\w+\[\s*['"]([^'"]+)['"]\s*\]\s*=\s*(['"])(.*)\2\s*;"""
FILE_LANG = r"lang-([a-z_]{2,})\.[a-z]+$"


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """``lang, line_no, message_key, message`` from ``lang, line_no, value``; commented lines are no entries."""
    key = F.regexp_extract("value", ENTRY, 1)
    text = F.regexp_replace(F.regexp_extract("value", ENTRY, 3), r"\\(['\"\\])", "$1")
    return lines.select("lang", "line_no", key.alias("message_key"), text.alias("message")).filter("message_key <> ''")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``lang, message_key, message`` of all catalogue files under ``path``; a later line of a key wins."""
    lines = spark.read.text(path).select(
        F.regexp_extract("_metadata.file_path", FILE_LANG, 1).alias("lang"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("line_no"),
        "value",
    )
    return latest_translations(parse_catalogue(lines.filter("lang <> ''")))
