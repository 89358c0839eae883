"""Debug logs of mail sessions: a UTC stamp, a tab and a text; folded lines carry a blank stamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.ordered import carry_last, in_ranges

# How a stamped line and its direction look.
STAMPED = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\t(?s)(.*)$"
DIRECTION = r"^(CLIENT -> SERVER|SERVER -> CLIENT): ?"


def _parsed(lines: DataFrame) -> DataFrame:
    stamp = F.regexp_extract("value", STAMPED, 1)
    first = F.regexp_extract("value", STAMPED, 2)
    direction = F.regexp_extract(first, DIRECTION, 1)
    head = F.when(stamp != "", F.struct(stamp.alias("ts"), direction.alias("direction")))
    text = F.when(stamp != "", F.regexp_replace(first, DIRECTION, "")).otherwise(F.ltrim(F.regexp_replace("value", r"^\s*\t\s*", "")))
    return lines.withColumns({"_head": head, "text": text})


def parse_transcript(lines: DataFrame) -> DataFrame:
    """``log, line_no, ts, direction, text`` from numbered lines ``log, line_no, value``.

    A folded line belongs to the stamp before it, however far back that is.
    """
    return _carried(in_ranges(_parsed(lines), ["log"], ["line_no"], "_block"))


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """The same from text files. Lines are numbered within each file split, so a large file stays many tasks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )
    return _carried(_parsed(lines))


def _carried(lines: DataFrame) -> DataFrame:
    known = carry_last(lines, ["log"], ["line_no"], "_head", "_known", "_block")
    return known.select(
        "log",
        "_block",
        "line_no",
        F.col("_known.ts").try_cast("timestamp").alias("ts"),
        F.coalesce("_known.direction", F.lit("")).alias("direction"),
        "text",
    )
