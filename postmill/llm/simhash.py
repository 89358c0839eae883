"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order.

Equal fingerprints are one code. Codes are sorted by their rank in the Gray code, in which neighbours share most bits, and cut
into leaves of ``LEAF`` codes. A node knows which bits all codes below it share (``mask``) and their values (``pattern``); ``FAN``
nodes have one parent, up to a root level of at most ``FAN`` nodes. Going down from pairs of root nodes, a pair of nodes whose
shared bits differ in more than ``bits`` places is dropped with all codes below, and pairs of leaves that are left compare
their codes. Every comparison of two codes within the distance survives, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import key_string, numbered, text_of
from postmill.llm.components import components
from postmill.session import durable

WIDTH = 3
BITS = 2
SEED = 42
LEAF = 256
FAN = 16
# Words of a text worked on at a time, and shingles whose bits are counted at a time: bound a task's memory for any text.
CHUNK = 1 << 16


def fingerprint_of(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number; ``bytes`` methods know ASCII letters and white space only."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashed, join, ones = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:min(at + CHUNK, n) + width - 1]
        shingles = map(join, zip(*[part[k:] for k in range(width)])) if len(words) >= width else [join(part)]
        hashes = np.fromiter((hashed(s, SEED) for s in shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``(doc_id, text)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint_of(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, fp bigint")


def gray_rank(code: Column) -> list[Column]:
    """Sort keys that put codes in Gray order: the prefix parities of the bits, as two unsigned halves."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return [F.shiftrightunsigned(rank, 32), rank.bitwiseAND(F.lit(0xFFFFFFFF))]


def _node(both: Column, either: Column) -> list[Column]:
    mask = F.bitwise_not(both.bitwiseXOR(either))
    return [mask.alias("mask"), both.bitwiseAND(mask).alias("pattern")]


def _levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Node tables ``(node, parent, mask, pattern)`` from the leaves up to a level of at most ``fan`` nodes."""
    parent = F.floor(F.col("node") / fan).alias("parent")
    levels = [leaves.select("node", parent, "mask", "pattern")]
    while levels[-1].count() > fan:
        ones = F.col("pattern")
        either = ones.bitwiseOR(F.bitwise_not("mask"))
        up = levels[-1].groupBy(F.col("parent").alias("node")).agg(F.expr("bit_and(pattern)").alias("a"), F.bit_or(either).alias("o"))
        levels.append(durable(up.select("node", parent, *_node(F.col("a"), F.col("o")))))
    return levels


def _close(bits: int) -> Column:
    both = F.col("a_mask").bitwiseAND(F.col("b_mask"))
    return F.bit_count(F.col("a_pattern").bitwiseXOR(F.col("b_pattern")).bitwiseAND(both)) <= bits


def _named(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns])


def leaf_pairs(leaves: DataFrame, bits: int = BITS, fan: int = FAN) -> DataFrame:
    """``(a, b)``, ``a <= b``: the leaves that may hold two codes within ``bits``."""
    levels = _levels(leaves, fan)
    # The root level has at most ``fan`` nodes, each of which meets itself and the later ones.
    every = F.explode(F.sequence(F.col("node"), F.lit(fan - 1).cast("bigint"))).alias("b")
    pairs = levels[-1].select(F.col("node").alias("a"), every)
    met_by = "node"
    for level in reversed(levels):
        a, b = _named(level, "a"), _named(level, "b")
        met = pairs.join(a, F.col("a") == F.col(f"a_{met_by}")).join(b, F.col("b") == F.col(f"b_{met_by}"))
        near = met.filter(_close(bits) & (F.col("a_node") <= F.col("b_node")))
        pairs = durable(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
        met_by = "parent"
    return pairs


def _compare(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for same, left, right in zip(batch.column(0), batch.column(1), batch.column(2)):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                i, j = np.nonzero(np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= bits)
                if same.as_py():
                    i, j = i[i < j], j[i < j]
                u.append(x[i])
                v.append(y[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return work


def close_codes(codes: DataFrame, bits: int = BITS, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``(u, v)``: the pairs of the distinct codes ``fp`` that differ in 1 to ``bits`` bits, each once.

    A code has at most 2,080 others within 2 bits, however many documents there are.
    """
    ranked = numbered(codes.select("fp"), gray_rank(F.col("fp"))).withColumn("node", F.floor(F.col("_n") / leaf))
    held = ranked.groupBy("node").agg(
        F.collect_list("fp").alias("codes"), F.expr("bit_and(fp)").alias("both"), F.expr("bit_or(fp)").alias("either")
    )
    leaves = durable(held.select("node", "codes", *_node(F.col("both"), F.col("either"))))
    pairs = leaf_pairs(leaves, bits, fan)
    left = leaves.select(F.col("node").alias("a"), F.col("codes").alias("x"))
    right = leaves.select(F.col("node").alias("b"), F.col("codes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select((F.col("a") == F.col("b")).alias("same"), "x", "y")
    return both.mapInArrow(_compare(bits), "u bigint, v bigint")


def near_groups(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` per document: its fingerprint and the smallest doc_id reachable over close fingerprints.

    Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other. A null doc_id takes
    part but never names a component unless all of it are null. Repeated rows stay repeated; an empty table gives no rows;
    other columns are ignored.
    """
    prints = durable(fingerprints(docs, width))
    codes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(close_codes(codes, bits))
    # Components are named by their smallest code; the smallest doc_id among their codes names the group.
    member = codes.join(linked, codes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    by_code = member.join(named, "component").select("fp", "component_id")
    return prints.join(by_code, "fp")


def one_per_group(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` of one document per group, the one with the smallest doc_id. Of repeated rows one stays."""
    groups = near_groups(docs, width, bits)
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key_string(F.col("doc_id")).alias("_key")).distinct()
    named = docs.select(
        key_string(F.col("doc_id").cast("bigint")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mark"),
    )
    within = Window.partitionBy("_key").orderBy("_mark")
    kept = named.join(firsts, "_key", "left_semi").withColumn("_nth", F.row_number().over(within))
    return kept.filter("_nth = 1").select("_row.*")
