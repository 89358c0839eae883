"""Sharding by rendezvous hashing: every record goes to the shard that scores highest for its key.

A shard's score for a key is ``-weight / ln(u)`` with ``u`` drawn from the hash of key and shard number. Scores do not depend
on the other shards, so one more shard takes its share of records from all and no record moves between the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import hash60, key_string, text_of

# Blocks that number a shard's records piecewise. A block is a share of a shard, whatever the input's size.
BLOCKS = 4096


def score(key: Column, shard: int, weight: float) -> Column:
    """Lower wins: the negative logarithm of a uniform draw, over the weight."""
    draw = (hash60(F.concat(key, F.lit(f":{shard}"))) + 1) / F.lit(float(2**60))
    return -F.log(draw) / F.lit(float(weight))


def entry(key: Column, shard: int, weight: float) -> Column:
    return F.struct(score(key, shard, weight).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Score and number of the best of ``len(weights)`` shards for a key; ties to the smaller number."""
    return F.array_min(F.array(*[entry(key, s, w) for s, w in enumerate(weights)]))


def place(
    rows: DataFrame, key: str, columns: Sequence[str], weights: Sequence[float], grown_weight: float | None = None
) -> DataFrame:
    """``columns`` of each row with ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (with one more shard).

    Rows equal in ``columns`` are counted before the shuffle and numbered as one run, so a key that owns a large share of the
    rows costs one row per task. The offsets of blocks are at most shards x ``BLOCKS`` rows.
    """
    columns = list(columns)
    text_key = key_string(F.col(key))
    one_more = entry(text_key, len(weights), weights[-1] if grown_weight is None else grown_weight)
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    placed = (
        groups.withColumn("_best", rendezvous(text_key, weights))
        .withColumn("_shard", F.col("_best.shard")).withColumn("_grown", F.least("_best", one_more)["shard"])
        .withColumn("_hash", hash60(F.concat_ws(":", *[key_string(F.col(c)) for c in columns])))
        .withColumn("_block", F.floor(F.col("_hash") / (2**60 // BLOCKS)))
    )
    sizes = placed.groupBy("_shard", "_block").agg(F.sum("_copies").alias("_size"))
    before = Window.partitionBy("_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_shard", "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard", "_block").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.col("_inside")
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .join(starts, ["_shard", "_block"])
        .select(
            *columns, F.col("_shard").alias("shard"), F.col("_grown").alias("grown_shard"),
            F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot"),
        )
    )


def shard_documents(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """Documents in ``shards`` shards by doc_id: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1; a null text has none (size 1, the CRC of the empty text). A null doc_id is one key.
    Repeated rows share their shard and get slots of their own; an empty table gives no rows; other columns are ignored.
    """
    text = text_of("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = place(rows, "doc_id", ["doc_id", "size", "text_crc32"], weights or [1.0] * shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
