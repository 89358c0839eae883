"""Column rules and ordering steps the operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import durable

# White space and letters as the data contracts define them; both are ASCII only.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. Inside a lambda, an expression would be worked out for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def text_of(column: str | Column) -> Column:
    """A text column as string, null as the empty text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else untouched. Texts without multi-byte characters take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """The runs of characters other than ``WHITE``: all white space becomes one space, which ``split`` cuts without a regex."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), WHITE[1:], text)
    return F.array_remove(F.split(spaced, " "), "")


def hash60(key: Column) -> Column:
    """The first 60 bits of a string's MD5 as a long: the same in any engine, so plain SQL can follow."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def key_string(column: Column) -> Column:
    """A key as text; null keys are one key of their own."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def numbered(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with ``_n``, its gapless number from 0 in ``order``, and ``_part``, the range it lies in.

    Rows are range-partitioned on ``order`` and written out, so that a rerun of a lost task finds the same ranges; one row
    per range is summed to give the ranges' first numbers.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    held = durable(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row for each range: bounded by the number of partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        held.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, "_part")
        .withColumn("_n", F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )
