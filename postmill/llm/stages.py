"""The stages of the corpus pipeline: ``(spark, docs, sf_dir)`` to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, linededup, mixing, quality, simhash


def _columns(docs: DataFrame) -> list[Column]:
    """All columns; names may hold dots and blanks."""
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, as they are.

    The rules remove lines to judge what is left, and only the verdict takes effect here: which lines go is for the next stage,
    which knows how often a line occurs. Null and empty texts are rejected, repeated rows kept or rejected alike; an empty table
    gives an empty one.
    """
    rows = docs.select(F.struct(*_columns(docs)).alias("_row"), "text")
    return quality.judge(rows, keep=("_row",)).filter("kept").select("_row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without common lines. One that has no other line stays, with what is left of its text.

    Null texts stay null; rows with one doc_id are one document when lines are counted, and repeated rows lose the same lines; an
    empty table gives an empty one.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rest = linededup.dedup_lines(docs.select("doc_id", "text", F.struct(*others).alias("_others")))
    fields = {c: F.col("text") if c == "text" else F.col(f"_others.`{c}`") for c in docs.columns}
    if "n_chars" in fields:
        left = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        fields["n_chars"] = F.when(F.col("text").isNotNull(), left).otherwise(fields["n_chars"])
    return rest.select(*[value.alias(c) for c, value in fields.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null, empty and wordless texts are near copies of each other. Of repeated rows one stays, of different rows with the kept doc_id
    the one with the smallest hash. A null doc_id stays only in a group without any other. An empty table gives an empty one.
    """
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, once per repeat, in the order of training; written files follow that order by their names.

    Texts without a word are never taken. A null source is one of its own; rows that repeat count as copies, and copies at the same
    time are ordered by a hash of the row. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, row by row: a null text has none, repeated rows stay, an empty table gives no rows."""
    return bpe.encode_documents(docs)
