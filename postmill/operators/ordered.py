"""Order-dependent steps that hold when one group owns a large share of the rows.

A plain window puts a whole group in one task. These sort the rows into ranges of (group, order), work inside each range, and
carry one summary row per range and group across the group. Ranges follow the rows, not their order numbers: sparse and tied
numbers are cut as evenly as any.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import durable, stored

# Rows and bytes of one group joined into one text.
SEGMENT = 200_000
SEGMENT_BYTES = 64 << 20
# Sums by hash that tell whether any group can be large.
HASHES = 1 << 18


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``block``, the number of the range of (group, order) a row lies in.

    The ranges are written to the shared folder: what is worked out from them, and a rerun of a lost task, see the same ones.
    """
    columns = [*group, *order]
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return durable(ranged.withColumn(block, F.spark_partition_id()))


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on ``keys``, null keys included."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same).drop(*[f"_right_{k}" for k in keys])


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, block: str
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group. ``block`` is a column that splits the group in order."""
    keys = [*group, block]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_value", value)
    offsets = (
        rows.groupBy(*keys).agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .transform(lambda left: on_keys(left, offsets, keys))
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_value", "_inside", "_before")
    )


def carry_last(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, block: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of the group."""
    keys = [*group, block]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carried = (
        df.groupBy(*keys).agg(latest.alias("_latest"))
        .withColumn("_carried", F.last("_latest", ignorenulls=True).over(before))
        .drop("_latest")
    )
    return (
        df.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
        .transform(lambda left: on_keys(left, carried, keys))
        .withColumn(out, F.coalesce("_seen", "_carried"))
        .drop("_seen", "_carried")
    )


def large_groups(df: DataFrame, group: Sequence[str], share: Column, limit: int) -> DataFrame | None:
    """The groups whose ``share`` adds up to more than ``limit``, or None where there is none.

    Groups are first added up by hash, which few rows per task tell; only where that is more than ``limit`` are groups told apart.
    ``df`` is read twice at most: store it where it is dear.
    """
    rows = df.select(*group, share.alias("_share"), F.pmod(F.xxhash64(*group), F.lit(HASHES)).alias("_hash"))
    hot = stored(rows.groupBy("_hash").agg(F.sum("_share").alias("_total")).filter(F.col("_total") > limit).select("_hash"))
    if hot.isEmpty():
        return None
    found = rows.join(hot, "_hash", "left_semi").groupBy(*group).agg(F.sum("_share").alias("_total"))
    found = stored(found.filter(F.col("_total") > limit).select(*group))
    return None if found.isEmpty() else found


def parted(df: DataFrame, group: Sequence[str], large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of all other groups, and those of the ``large`` ones; null keys are a group."""
    if large is None:
        return df, None
    named = large.withColumnsRenamed({k: f"_large_{k}" for k in group})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in group])
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def whole_texts(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], piece: str, separator: str = "", carry: Sequence[Column] = (), bundle: str | None = None
) -> DataFrame:
    """``group..., text, carry...``: the pieces of each group joined in order, a group in one task.

    Rows that lie by the group, or by some of its columns, stay where they are. ``bundle`` is as in ``ordered_concat``, which is for
    groups that can be large.
    """
    gathered = F.flatten(F.collect_list(bundle)) if bundle else F.collect_list(F.struct(*order, F.coalesce(F.col(piece), F.lit("")).alias(piece)))
    # sort_array and the field of all elements at once are compiled; array_sort and transform are not.
    return rows.groupBy(*group).agg(F.array_join(F.sort_array(gathered)[piece], separator).alias("text"), *carry)


def ordered_concat(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    piece: str,
    separator: str = "",
    segment_rows: int = SEGMENT,
    segment_bytes: int = SEGMENT_BYTES,
    carry: Sequence[Column] = (),
    bundle: str | None = None,
) -> DataFrame:
    """Join the pieces of each group in order: ``(group..., segment, segments, text, carry...)``.

    A text comes in ``segments`` pieces numbered from 0; joining those in order with the same separator gives all of it. A segment has
    at most ``segment_rows`` rows and, but for a single larger piece, about ``segment_bytes`` bytes: a row's share of a segment is one
    row or its bytes, whichever is more, and segments are cut where the shares before a row make a whole number. So the cuts
    depend on the rows alone, not on how they are spread. ``carry`` are aggregates worked out per segment.

    A group that makes one segment goes to one task, which is all that its text takes anyway; larger ones go by ranges. ``df`` is read
    up to three times: store it where it is dear.

    Rows may hold several pieces each: ``bundle`` names an array of structs of ``order`` and ``piece``, none null, and there is no
    ``carry``. Such rows are stored here, with their shares.

    A group whose rows tie in ``order`` puts them in one range; give an order that tells rows apart.
    """
    group, order = list(group), list(order)
    unit = max(1, segment_bytes // segment_rows)

    def share(text: Column) -> Column:
        return F.least(F.lit(segment_rows), F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(unit)))).cast("bigint")

    def joined(rows: DataFrame, keys: list[str], bundle: str | None = None) -> DataFrame:
        return whole_texts(rows.repartition(*keys), keys, order, piece, separator, carry, bundle)

    if bundle:
        # No less than the sum of its pieces' shares: one each and one more for every ``unit`` bytes.
        n_bytes = F.octet_length(F.array_join(F.col(bundle)[piece], ""))
        shares = F.size(bundle).cast("bigint") + F.floor(n_bytes / F.lit(unit)).cast("bigint")
        named = stored(df.select(*group, bundle, shares.alias("_shares")))
        all_shares = F.col("_shares")
    else:
        named = df.withColumn(piece, F.coalesce(F.col(piece), F.lit("")))
        all_shares = share(F.col(piece))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    small, large = parted(named, group, large_groups(named, group, all_shares, segment_rows))
    whole = joined(small, group, bundle).withColumn("segment", zero).withColumn("segments", one)
    if large is None:
        return whole
    if bundle:
        large = large.select(*group, F.inline(bundle))
    placed = running_total(in_ranges(large, group, order, "_range"), group, order, share(F.col(piece)), "_place", "_range")
    cut = placed.withColumn("_cut", F.floor(F.col("_place") / segment_rows))
    parts = joined(cut, [*group, "_cut"])
    # A segment's number counts the cuts before it: one row per segment.
    along = Window.partitionBy(*group)
    numbered = parts.withColumn("segment", (F.row_number().over(along.orderBy("_cut")) - 1).cast("bigint")).withColumn(
        "segments", F.count(F.lit(1)).over(along)
    ).drop("_cut")
    return whole.unionByName(numbered)
