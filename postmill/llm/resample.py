"""Resampling documents towards a target distribution, by importance weights over hashed word runs.

Runs of one and two words fall into buckets. The logarithm of how much likelier the target makes a bucket than the corpus does is
the bucket's gain; all gains together are one array of fixed length, and a document's weight is the mean of the array's entries
at its runs. Gumbel noise, a fixed function of the document's id, turns the highest scores into a draw without replacement.

The cutoff of the draw is found without a sort of all scores: a quantile sketch brackets it, exact counts of the scores outside
tell whether it lies inside, and if not the bracket is widened. Only the scores in the bracket are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import key_string, numbered, text_of
from postmill.session import durable

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
# A sketch's ranks are off by at most one in so many; the first bracket is so many times that wide on each side.
ACCURACY = 10_000
MARGIN = 2
# Bytes of a text cut into words at a time.
CHUNK = 1 << 20
# Per byte of UTF-8: digits, letters in lower case and bytes of longer characters stay, all else becomes a blank.
KEPT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def buckets_of(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, int]]:
    """Piece by piece: the buckets of a text's runs of one and two words, and how many words they end at.

    The checksum of a run of two is that of its first word, carried on over a blank and the second.
    """
    plain, at, before = text.translate(KEPT), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        words = plain[at:end if end >= 0 else len(plain)].split()
        at = end if end >= 0 else len(plain)
        if not words:
            continue
        single = list(map(crc32, words))
        first = single[:-1] if before is None else [before, *single[:-1]]
        double = map(crc32, words[1:] if before is None else words, map(crc32, repeat(b" "), first))
        hashes = np.fromiter(single, np.uint32, len(single)), np.fromiter(double, np.uint32, len(first))
        before = single[-1]
        yield np.concatenate(hashes) % buckets, len(words)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over the column ``text``: tasks hand on one row per bucket at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in buckets_of(text.as_py(), buckets):
                    held += np.bincount(found, minlength=buckets)
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], ["bucket", "n"])

    rows = texts.select(text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from ``bucket_counts`` of corpus and target; the driver sees one number per bucket of each."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for bucket, n in counts.toLocalIterator():
            into[bucket] = n
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    # Whole numbers of any size divide to the nearest double.
    ratios = [((int(x) + 1) * all_s) / ((int(y) + 1) * all_t) for x, y in zip(t, s)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of ``(doc_id, text)``: the mean gain of a text's runs, rounded down."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(1)):
                n_words = n = total = 0
                for found, words in buckets_of(text.as_py(), len(gain)):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
                out[:, row] = n_words, n, total // n if n else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    texts = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return texts.mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw, rounded down, from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform)))


def highest(rows: DataFrame, score: str, take: int, ties: Sequence[str]) -> DataFrame:
    """``rows`` (written, so that they can be read again) with ``rank`` from 1 for the ``take`` highest of ``score``; null for the rest.

    Ties go to the smaller ``ties``. Rows equal in all of these are drawn in any order.
    """
    null_rank = F.lit(None).cast("bigint").alias("rank")
    n = rows.count()
    if not 0 < take <= n:
        return rows.select("*", null_rank)
    width = MARGIN / ACCURACY
    while True:
        share = 1 - take / n
        low, high = rows.agg(F.percentile_approx(score, [max(0.0, share - width), min(1.0, share + width)], ACCURACY)).first()[0]
        above = rows.filter(F.col(score) > high).count()
        below = rows.filter(F.col(score) < low).count()
        if above < take <= n - below:
            break
        if width >= 1:
            low, high, above = None, None, 0
            break
        width *= 4
    inside = rows if low is None else rows.filter(F.col(score).between(low, high))
    order = [F.desc(score), *ties]
    last = numbered(inside.select(score, *ties), order).filter(F.col("_n") == take - above - 1).first()
    level = F.lit(last[score])
    after = F.lit(False)
    for tie in reversed(ties):
        now = F.lit(last[tie]).cast(rows.schema[tie].dataType)
        # Ascending order puts nulls first.
        after = (now.isNull() & F.col(tie).isNotNull()) | F.coalesce(F.col(tie) > now, F.lit(False)) | (F.col(tie).eqNullSafe(now) & after)
    drawn = (F.col(score) > level) | ((F.col(score) == level) & ~after)
    ranked = numbered(rows.filter(drawn), order).select(*rows.columns, F.when(F.col("_n") < take, F.col("_n") + 1).alias("rank"))
    return ranked.unionByName(rows.filter(~drawn).select("*", null_rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Draw ``percent`` of ``docs`` with at least ``min_words`` words so that they come to look like ``target``.

    Gives every document's doc_id, n_features, weight, score and rank: 1, 2, 3... for the drawn from the highest score down, null
    for the others. Null and empty texts have no feature and weight 0. Equal scores go to the smaller doc_id, null first; a null
    doc_id draws its noise as 'null'. Repeated rows each count and are each drawn or not. An empty target has no counts; an empty
    table gives no rows; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    scored = durable(weighed(docs, gain).withColumn("score", F.col("weight") + noise(key_string(F.col("doc_id")))))
    fit = scored.filter(F.col("n_words") >= min_words)
    ranked = highest(fit, "score", percent * fit.count() // 100, ["doc_id", "n_features", "weight"])
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
