"""Nearest neighbours by inner product with a forest of hash prefixes.

Every tree hashes a vector to a long string: each symbol says on which of many random directions, with sign, the vector lies
closest. A tree is a sorted array of strings, so all vectors that share a prefix with a query are one stretch of it. A query goes
down every tree to its longest matches and then up in all trees at once, one symbol shorter at a time, until the trees together
offer enough vectors. Those offered by most trees are scored exactly.

The vectors are cut into blocks by hash, each with a forest of its own that keeps the vectors beside the arrays; the queries
visit the blocks in chunks. So offers are counted and scored where they lie, and only each block's best leave it.
Inner products become angles by one more component that brings all vectors to the same length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import durable

NEAREST = 20
QUERY_EVERY = 20
TREES = 128
# Random directions of a string's symbols, first to last. Two signs each, so a symbol has twice as many values.
DIRECTIONS = (32, 16, 16, 8, 8, 8, 8, 8)
# Vectors of a block, queries of a chunk, what a block's trees have to offer in all before a query stops going up, and how many of
# the offered are scored.
BLOCK = 8192
CHUNK = 2048
OFFERS = 8192
SCORED = 1280
# Vectors hashed at a time.
AT_ONCE = 512


@lru_cache(maxsize=2)
def _directions(size: int, trees: int) -> list[np.ndarray]:
    draw = np.random.default_rng(20)
    return [draw.standard_normal((size, trees * n)).astype(np.float32) for n in DIRECTIONS]


def _strings(vectors: np.ndarray, trees: int = TREES) -> np.ndarray:
    """One string per vector and tree, as an integer whose leading digits are its prefix."""
    if len(vectors) > AT_ONCE:
        return np.vstack([_strings(vectors[at:at + AT_ONCE], trees) for at in range(0, len(vectors), AT_ONCE)])
    strings = np.zeros((len(vectors), trees), np.int64)
    for n, matrix in zip(DIRECTIONS, _directions(vectors.shape[1], trees)):
        along = (vectors.astype(np.float32) @ matrix).reshape(len(vectors), trees, n)
        at = np.abs(along).argmax(axis=2)
        sign = np.take_along_axis(along, at[:, :, None], axis=2)[:, :, 0] < 0
        strings = strings * (2 * n) + 2 * at + sign
    return strings


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    """A list column as a matrix; shorter lists are filled up with zeros."""
    out = np.zeros((len(column), size))
    for row, vector in zip(out, column):
        values = vector.values.to_numpy(zero_copy_only=False)
        row[:len(values)] = values
    return out


def _index(size: int, longest: float):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        vectors = _unpacked(table["vec"].combine_chunks(), size)
        square = (vectors / longest) ** 2
        same = np.hstack([vectors / longest, np.sqrt(np.maximum(0.0, 1 - square.sum(1)))[:, None]])
        strings = _strings(same).T
        order = strings.argsort(axis=1, kind="stable").astype(np.int32)
        row = {
            "block": table["block"][:1], "reps": [table["rep"].to_numpy().tobytes()], "vecs": [vectors.tobytes()],
            "strings": [np.take_along_axis(strings, order, axis=1).tobytes()], "order": [order.tobytes()],
        }
        return pa.table(row, schema=pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in list(row)[1:]]]))

    return build


def _pack(size: int):
    def pack(table: pa.Table) -> pa.Table:
        vectors = _unpacked(table["vec"].combine_chunks(), size)
        peak = np.abs(vectors).max(axis=1, keepdims=True)
        unit = np.hstack([vectors / peak, np.zeros((len(vectors), 1))])
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        row = {
            "chunk": table["chunk"][:1], "queries": [table["rep"].to_numpy().tobytes()], "sought": [vectors.tobytes()],
            "keys": [_strings(unit).tobytes()],
        }
        return pa.table(row, schema=pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in list(row)[1:]]]))

    return pack


def _stretches(strings: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per prefix length from none to all, tree and query: where the stretch of the sorted array with the query's prefix lies."""
    widths = np.cumprod([1, *[2 * n for n in DIRECTIONS[::-1]]], dtype=np.int64)[::-1]
    trees, n = strings.shape
    low = np.zeros((len(widths), trees, len(keys)), np.int32)
    high = np.full_like(low, n)
    for level, width in enumerate(widths[1:], 1):
        for tree in range(trees):
            first = keys[:, tree] // width * width
            low[level, tree] = strings[tree].searchsorted(first, "left")
            high[level, tree] = strings[tree].searchsorted(first + width - 1, "right")
    return low, high


def _search(size: int, nearest: int):
    def search(table: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "rep": [], "score": []}
        for row in table.to_pylist():
            reps = np.frombuffer(row["reps"], np.int64)
            vectors = np.frombuffer(row["vecs"], float).reshape(len(reps), size)
            strings = np.frombuffer(row["strings"], np.int64).reshape(-1, len(reps))
            order = np.frombuffer(row["order"], np.int32).reshape(-1, len(reps))
            queries = np.frombuffer(row["queries"], np.int64)
            sought = np.frombuffer(row["sought"], float).reshape(len(queries), size)
            low, high = _stretches(strings, np.frombuffer(row["keys"], np.int64).reshape(len(queries), -1))
            offers = (high - low).sum(axis=1, dtype=np.int64)  # by prefix length and query; the root offers everything
            for q in range(len(queries)):
                level = int(np.nonzero(offers[:, q] >= min(OFFERS, offers[0, q]))[0][-1])
                if level:
                    at = np.concatenate([order[t, i:j] for t, (i, j) in enumerate(zip(low[level, :, q], high[level, :, q]))])
                    votes = np.bincount(at, minlength=len(reps))
                    picked = np.nonzero(votes)[0]
                    if len(picked) > SCORED:
                        picked = np.argpartition(-votes, SCORED)[:SCORED]
                else:  # up at the root, every tree offers everything
                    picked = np.arange(len(reps))
                # Products are summed one component after the other, so equal vectors score the same wherever they lie.
                scores = np.add.accumulate(vectors[picked] * sought[q], axis=1)[:, -1]
                best = np.lexsort((reps[picked], -scores))[:nearest]
                found["query"].append(np.full(len(best), queries[q]))
                found["rep"].append(reps[picked][best])
                found["score"].append(scores[best])
        types = {"query": np.int64, "rep": np.int64, "score": float}
        return pa.table({c: np.concatenate([np.zeros(0, types[c]), *v]) for c, v in found.items()})

    return search


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """The ``nearest`` of ``vectors`` ``(vec_id, vec)`` for each of ``queries`` ``(vec_id, vec)``: query_id, rank, vec_id, score.

    Equal vectors are indexed and sought once; of copies only the ``nearest + 1`` smallest ids can be an answer. Null, empty and zero
    vectors, those with null or non-finite components, and null ids take no part. Vectors of unequal length count as if filled up
    with zeros. Repeated rows are one; an empty table gives no rows; products beyond the range of doubles are infinite. A table too small to fill the demand is searched whole, so all candidates are found.
    """
    more = nearest + 1

    def sound(rows: DataFrame) -> DataFrame:
        vec = F.col("vec").cast("array<double>")
        fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
        # Trailing zeros change no product; adding zero makes a negative zero positive, so equal vectors group together.
        return rows.filter(F.col("vec_id").isNotNull()).filter(fine).select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(vec, lambda x: x + F.lit(0.0)).alias("vec")
        )

    first = Window.partitionBy("vec").orderBy("vec_id")
    ranked = sound(vectors).withColumn("_nth", F.dense_rank().over(first)).filter(F.col("_nth") <= more)
    held = durable(ranked.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("rep", F.get("ids", 0)))
    asked = sound(queries).distinct()
    known = durable(asked.groupBy("vec").agg(F.min("vec_id").alias("rep")))
    # Lengths by way of the largest component, so that squares stay finite.
    peak = F.array_max(F.transform("vec", F.abs))
    norm = F.sqrt(F.aggregate(F.transform("vec", lambda x: x / peak), F.lit(0.0), lambda s, x: s + x * x)) * peak
    size, longest, n = held.agg(F.max(F.size("vec")), F.max(norm), F.count(F.lit(1))).first()
    asked_size, n_asked = known.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    size, longest = max(size or 1, asked_size or 1), longest or 1.0
    blocks, chunks = -(-n // block) or 1, -(-n_asked // chunk) or 1

    index = durable(
        held.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("block"), "rep", "vec").groupBy("block")
        .applyInArrow(_index(size, longest), "block bigint, reps binary, vecs binary, strings binary, order binary")
    )
    packed = durable(
        known.select(F.pmod(F.xxhash64("rep"), F.lit(chunks)).alias("chunk"), "rep", "vec").groupBy("chunk")
        .applyInArrow(_pack(size), "chunk bigint, queries binary, sought binary, keys binary")
    )
    visits = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))).join(
        packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))), ["block", "chunk"]
    )
    found = visits.groupBy("block", "chunk").applyInArrow(_search(size, more), "query bigint, rep bigint, score double")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = found.withColumn("_nth", F.row_number().over(by_query)).filter(F.col("_nth") <= more)
    each = best.select("query", "rep", "score").join(held.select("rep", "ids"), "rep").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    cut = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = each.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("_nth", F.row_number().over(cut))
    answers = answers.filter(F.col("_nth") <= more).drop("_nth")
    ids = asked.select(F.col("vec_id").alias("query_id"), "vec").join(known.select("vec", F.col("rep").alias("query")), "vec")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        ids.select("query_id", "query").join(answers, "query").filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_embeddings(embeddings: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """``nearest_neighbours`` of the rows of ``embeddings`` whose vec_id is divisible by ``every``, among all rows."""
    vectors = embeddings.select("vec_id", F.col("embedding").alias("vec"))
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % every == 0))
