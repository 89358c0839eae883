"""How filters interact in every order, by min-plus removal ranks.

A row's failures are a mask over the filters. An order of the filters is a permutation; its inverse says at which step each filter
stands. Masks as a matrix of 0 (fails) and infinity (passes) and inverse permutations as a matrix of steps combine by minimum of
sums, the product of the min-plus algebra: entry (mask, order) is the step at which rows with this mask are removed. Rows are
counted by part and mask once, and those counts, scattered by removal step, give all figures of all orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import UPPER, let, text_of, words_of
from postmill.session import durable

# A mask per set of filters and a row per order and step: seven filters are 128 masks and 35,280 rows per part.
MOST_FILTERS = 7
MIN_WORDS = 200
LEAST_DISTINCT = 50  # per cent of the words
MOST_CAPITALS = 3  # per cent of the code points
SIGNS = "#$%&*|"
# What two texts have to share to count as identical: 128 bits of hash and their length.
SAME = ("_t1", "_t2", "_size")


@lru_cache(maxsize=4)
def orders(names: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    """All orders as strings, and their inverse permutations: row per order, column per filter, its step from 1."""
    every = np.array(list(permutations(range(len(names)))))
    return ["".join(names[f] for f in order) for order in every], every.argsort(axis=1) + 1


def removal_ranks(masks: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The min-plus product of masks (0 fails, infinity passes) and steps: when each mask is removed in each order, or infinity."""
    return (masks[:, None, :] + steps[None, :, :]).min(axis=2)


def _audited(names: tuple[str, ...], weights: Sequence[str]):
    n = len(names)
    failing = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 == 1  # mask x filter
    masks = np.where(failing, 0.0, np.inf)

    def tables(counts: np.ndarray) -> dict[str, np.ndarray]:
        """``counts``: rows, then each weight, per mask. Every figure as a matrix of orders and steps."""
        labels, steps = orders(names)
        at = removal_ranks(masks, steps)
        removed, redundant = (np.zeros((len(labels), n), np.int64) for _ in range(2))
        lost = [np.zeros((len(labels), n), np.int64) for _ in weights]
        order = np.arange(len(labels))
        for mask in range(1, 1 << n):
            step = at[mask].astype(int) - 1
            removed[order, step] += counts[0, mask]
            for table, column in zip(lost, counts[1:]):
                table[order, step] += column[mask]
            for f in np.nonzero(failing[mask])[0]:
                later = steps[:, f] - 1 > step
                redundant[order[later], steps[later, f] - 1] += counts[0, mask]
        filter_at = steps.argsort(axis=1)  # order x step: the filter that stands there
        alone = counts[0, 1 << np.arange(n)]
        share = np.array([removed[order, steps[:, f] - 1].sum() for f in range(n)])
        return {
            "kept": counts[0].sum() - removed.cumsum(axis=1), "removed": removed, "redundant": redundant,
            "unique_fails": alone[filter_at], **{f"{w}_lost": t for w, t in zip(weights, lost)}, "shapley": share[filter_at],
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, _ = orders(names)
        for batch in batches:
            for part, cells in zip(batch.column(0), batch.column(1)):
                counts = np.zeros((1 + len(weights), 1 << n), np.int64)
                for cell in cells.as_py():
                    counts[:, cell["mask"]] += [cell["rows"], *(cell[w] for w in weights)]
                columns = {
                    "part": pa.array([part.as_py()] * (len(labels) * n), pa.string()), "filter_order": np.repeat(labels, n),
                    "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(labels)),
                    **{c: t.astype(np.int64).ravel() for c, t in tables(counts).items()},
                }
                yield pa.RecordBatch.from_pydict(columns)

    return work


def audit(rows: DataFrame, part: str, fails: Sequence[str], weights: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """Figures per value of ``part``, order of the filters ``fails`` (boolean columns; null passes) and step.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter but were removed earlier), ``unique_fails`` (fail no
    other filter), ``<weight>_lost`` (the sum of the long column over the removed) and ``shapley`` (its filter's removals summed
    over all orders). A row counts ``copies`` times. Rows are counted by part and mask before the shuffle; a part then is one row
    of at most 2^filters counts.
    """
    names = tuple(fails)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    mask = sum((F.when(F.col(c), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, c in enumerate(names)), F.lit(0))
    times = F.col(copies) if copies else F.lit(1)
    counted = rows.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(
        F.sum(times).alias("rows"), *[F.sum(F.coalesce(F.col(w).cast("bigint"), F.lit(0)) * times).alias(w) for w in weights]
    )
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", *weights)).alias("cells"))
    longs = ["kept", "removed", "redundant", "unique_fails", *[f"{w}_lost" for w in weights], "shapley"]
    schema = f"part string, filter_order string, step int, {', '.join(f'`{c}` bigint' for c in longs)}"
    return cells.mapInArrow(_audited(names, list(weights)), schema)


def _own_failures(text: Column) -> Column:
    """Filters A to D: what a text's own words and characters decide."""

    def of_words(words: Column) -> Column:
        n_words = F.size(words).cast("bigint")
        return F.struct((n_words < MIN_WORDS).alias("A"), (F.size(F.array_distinct(words)) * F.lit(100).cast("bigint") < n_words * LEAST_DISTINCT).alias("B"))

    n_chars = F.char_length(text).cast("bigint")
    capitals = n_chars - F.char_length(F.translate(text, UPPER, ""))
    by_words = let(words_of(text), of_words)
    return let(by_words, lambda w: F.struct(
        w["A"].alias("A"), w["B"].alias("B"), (capitals * 100 > n_chars * MOST_CAPITALS).alias("C"),
        (F.char_length(F.translate(text, SIGNS, "")) < n_chars).alias("D"),
    ))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over ``docs`` by language; ``labels`` tells good (quality 1) and toxic (toxic 1) documents.

    A few words, B few distinct words, C capitals, D signs, E text identical to that of a smaller doc_id. Null and empty texts are
    empty: they fail A, and E after the first. A null or empty language is the part ''. A row without a doc_id is neither smaller
    nor larger than another, so it passes E, and has no labels; rows that share a doc_id pass E alike. A document labelled more than
    once is good or toxic if any of its labels says so. No documents, no rows; other columns are ignored.

    Only the first doc_id of each text is looked up, by text and doc_id, so a large group of copies never meets in one task.
    """
    text = text_of("text")
    rows = durable(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("text"), text).alias("_t2"), F.octet_length(text).alias("_size"),
        _own_failures(text).alias("_own"),
    ).groupBy("doc_id", "part", *SAME, "_own").agg(F.count(F.lit(1)).alias("_copies")))
    firsts = rows.groupBy(*SAME).agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("_first", F.lit(True))
    says = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    judged = rows.join(firsts, ["doc_id", *SAME], "left").join(says, "doc_id", "left").select(
        "part", "_own.*", (F.col("_first").isNull() & F.col("doc_id").isNotNull()).alias("E"), "good", "toxic", "_copies",
    )
    return audit(judged, "part", ("A", "B", "C", "D", "E"), ("good", "toxic"), "_copies")
