"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: how strongly it is drawn on as training goes from time 0 to 1. Its integral, scaled to the
source's target, is the source's cumulative demand for words. A source's documents stand in a fixed random order, over and
over, and fill that demand one after the other; inverting the demand at a copy's place gives its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import hash60, key_string, numbered, text_of, words_of
from postmill.session import durable

# Weights in the order of the sources, over and over, and the relative strength of each weight's sources at start and end.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
# No source is repeated more often.
MOST_REPEATS = 3
# Blocks that sum up a source piecewise: shares of a source, whatever its size.
BLOCKS = 1024


def _cycle(values: Sequence[float], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES
) -> DataFrame:
    """``source, source_size`` with ``target``, ``start`` and ``end`` strength.

    Targets share all sizes by weight and stop at ``MOST_REPEATS`` times the source's size; what is above is shared again
    among the others, by weight, until none is above. Every round caps at least one more source; the driver sees two sums.
    """
    named = numbered(sizes, [F.col("source").isNull(), F.col("source")])
    open_ = durable(named.select(
        "source", "source_size", _cycle(weights, F.col("_n")).alias("weight"),
        _cycle([s for s, _ in schedules], F.col("_n")).alias("start"), _cycle([e for _, e in schedules], F.col("_n")).alias("end"),
    ))
    most = F.col("source_size") * MOST_REPEATS
    total = open_.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, F.lit(False)
    while total:
        left = open_.select(
            F.coalesce(F.sum(F.when(fixed, most)), F.lit(0)), F.sum(F.when(fixed, F.lit(0.0)).otherwise(F.col("weight")))
        ).first()
        if not left[1]:
            break
        level = (total - left[0]) / left[1]
        above = fixed | (F.col("weight") * F.lit(level) > most)
        if not open_.filter(above & ~fixed).limit(1).count():
            break
        fixed = F.col("weight") * F.lit(level) > most
    return open_.select(
        "source", "source_size", F.least(F.col("weight") * F.lit(level), most.cast("double")).alias("target"), "start", "end"
    )


def moment(share: Column, start: Column, end: Column) -> Column:
    """The time at which a schedule going straight from ``start`` to ``end`` has met ``share`` of its integral.

    The integral is ``start * t + (end - start) * t^2 / 2`` over ``(start + end) / 2``; its inverse is written so that flat
    schedules need no case of their own.
    """
    need = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (start + end)
    root = start + F.sqrt(start * start + (end - start) * need)
    return F.when(root > 0, need / root).otherwise(F.lit(0.0))


def mix(rows: DataFrame, key: str, others: Sequence[str] = (), **settings) -> DataFrame:
    """How often each row of ``(key, source, size, others...)`` is taken, and when.

    Gives the columns with ``_copies`` equal rows each, ``source_size``, ``target`` and ``_times``: for each of the equal rows an
    array with one training time in [0, 1] per repeat. A copy is taken if its middle lies within the source's target.
    Windows run within blocks of a source, cut by hash, and one row per block carries the sums on.
    """
    columns = [key, "source", "size", *others]
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn(
        "_hash", hash60(F.concat(key_string(F.col(key)), F.lit(":mix")))
    ).withColumn("_block", F.floor(F.col("_hash") / (2**60 // BLOCKS)))
    mass = F.col("size") * F.col("_copies")
    sizes = groups.groupBy("source", "_block").agg(F.sum(mass).alias("_mass"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("_mass").alias("source_size")), **settings)
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("_start", F.coalesce(F.sum("_mass").over(before), F.lit(0)))
        .alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "_block", "_start", "source_size", "target", "start", "end")
    )
    inside = Window.partitionBy("source", "_block").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_inside", F.coalesce(F.sum(mass).over(inside), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p._block") == F.col("s._block"))
    joined = placed.alias("p").join(starts.alias("s"), same).select(
        *[F.col(f"p.{c}").alias(c) for c in columns], "_copies", "source_size", "target",
        (F.col("_start") + F.col("_inside")).alias("_from"), "start", "end",
    )

    def time_of(place: Column) -> Column:
        return moment(place / F.col("target"), F.col("start"), F.col("end"))

    def times(copy: Column) -> Column:
        first = F.col("_from") + copy * F.col("size")
        middles = F.transform(F.array(*[F.lit(r) for r in range(MOST_REPEATS)]), lambda r: first + r * F.col("source_size") + F.col("size") / 2)
        return F.transform(F.filter(middles, lambda m: (F.col("size") > 0) & (m <= F.col("target"))), time_of)

    return joined.withColumn("_times", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1), times)).drop("_from", "start", "end")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc_id, source, size, more...)``, written: the texts are read and cut into words once, whatever follows."""
    return durable(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(words_of(text_of("text"))).cast("bigint").alias("size"), *more,
    ))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, first_time, first_position.

    ``first_time`` is when its first copy comes in training, by the inverted demand of its source; ``first_position`` the number of
    documents taken before that, repeats counted, over all sources. Both are null where nothing is taken. Of copies at the same
    time, the smaller doc_id comes first.

    Null texts have size 0 and are never taken, nor are texts without a word. A null source is a source of its own, after all
    others. Repeated rows each count and are each taken or left. An empty table gives no rows; other columns are ignored.
    """
    each = durable(mix(sized(docs), "doc_id").select("doc_id", "size", "source_size", "target", F.explode("_times").alias("_own")))
    # Equal rows with equal times: any of them comes first, so they are told apart by a number within the task that made them.
    told = each.withColumn("_row", F.monotonically_increasing_id())
    copies = told.select("_row", "doc_id", "size", F.explode("_own").alias("_time"))
    ranked = numbered(copies, [F.col("_time"), F.col("doc_id"), F.col("size"), F.col("_row")])
    places = ranked.groupBy("_row").agg(F.min("_n").alias("first_position"))
    return told.join(places, "_row", "left").select(
        "doc_id", "size", "source_size", "target", (F.size("_own") * F.col("size")).cast("bigint").alias("taken"),
        F.array_min("_own").alias("first_time"), "first_position",
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix as rows, repeats included, range-sorted by training position.

    Rows equal in every column are one document with as many copies: the texts travel once, under 128 bits of hash of the whole
    row. The order is that of the rows, and of the files they are written to; reading such files again packs them by size.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    marks = [F.xxhash64(*every).alias("_m1"), F.xxhash64(F.lit("row"), *every).alias("_m2")]
    names = ["_m1", "_m2"]
    first = Window.partitionBy(*names).orderBy(F.lit(1))
    single = docs.select(F.struct(*every).alias("_row"), *marks).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    rows = sized(docs, *marks)
    taken = mix(rows, "doc_id", names, **settings).select(*names, F.explode(F.flatten("_times")).alias("_time"))
    return single.join(taken, names).repartitionByRange("_time", *names).sortWithinPartitions("_time", *names).select("_row.*")
