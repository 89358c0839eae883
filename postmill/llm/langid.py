"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence are multiplied: how likely the page's text is in each language (byte trigrams), the language its markup
declares, the suffix of its address, and what the other pages of its host are written in. Host priors are smoothed over
a hierarchy: a host leans on its domain, a domain on the whole table. How far declarations and suffixes can be trusted is not assumed but
counted, by grouped sums over all pages of what the texts alone say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import text_of
from postmill.session import durable

# Bound of the labelled sample the text model is fitted on: so many documents of each language, those with the smallest hash.
SAMPLE_DOCS = 500
BUCKETS = 1 << 13
# Overlapping trigrams repeat each other's evidence: their sum counts by this factor.
TEMPER = 0.2
# Weight of the level above, in pages, when a host's or domain's languages are smoothed; and of evenness when signs are counted.
LEAN = 4.0
EVEN = 1.0
# Elements whose content is no prose, up to their end tag.
SKIPPED_END = r"(?i)</(?:script|style|nav|noscript)\b[^<>]*+>"
SKIPPED = r"(?is)<(?:script|style|nav|noscript)\b.*+"
TAG = r"<[^<>]*+>"
DECLARED = r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})"
HOST = r"(?i)^[a-z][a-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:@]++)"


def page_text(html: Column) -> Column:
    parts = F.transform(F.split(html, SKIPPED_END), lambda p: F.regexp_replace(p, SKIPPED, " "))
    return F.regexp_replace(F.array_join(parts, " "), TAG, " ")


def _buckets(text: bytes) -> np.ndarray:
    """The trigrams of a text's bytes in lower case, white space as one sign, each as a bucket's number."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    gram = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - 13)


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages of ``(doc_id, text, lang)``, and per language the log probability of each bucket.

    At most languages x ``BUCKETS`` counts reach the driver.
    """
    nth = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (
        labelled.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang", "text")
        .withColumn("_nth", F.row_number().over(nth)).filter(F.col("_nth") <= sample_docs)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counts = np.bincount(_buckets(text.as_py()), minlength=BUCKETS)
                there = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(there)), pa.array(there.astype(np.int32)), pa.array(counts[there].astype(np.int64))],
                    ["lang", "bucket", "n"],
                )

    rows = sample.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, bucket int, n bigint")
    summed = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(summed["lang"]))
    table = np.ones((len(langs), BUCKETS))
    np.add.at(table, (np.array([langs.index(x) for x in summed["lang"]], int), np.array(summed["bucket"], int)), np.array(summed["n"], float))
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _text_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """``pages`` with ``evidence`` instead of ``_text``: per language the tempered log likelihood, the best as 0."""
    keep = [c for c in pages.columns if c != "_text"]
    by_bucket = np.ascontiguousarray(model.T.astype(np.float32))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("_text").to_pylist():
                sums = np.bincount(_buckets(text), minlength=BUCKETS) @ by_bucket if text.strip() else np.zeros(by_bucket.shape[1])
                rows.append((TEMPER * (sums - sums.max())).tolist())
            evidence = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], evidence], [*keep, "evidence"])

    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.mapInArrow(weigh, f"{schema}, evidence array<double>")


def _normal(logs: Column) -> Column:
    """Probabilities from log weights."""
    weights = F.transform(logs, F.exp)
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per group: how many pages the texts give to each language."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.get("likely", k)) for k in range(n)]).alias("held"))


def identify(pages: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per page: page_id, lang, confidence, text_lang, declared, suffix, host.

    ``pages`` holds page_id, url and html, ``labelled`` doc_id, text and lang. A page without text, host or declaration is judged by
    the evidence it has, one with none of it by the whole table's languages. Its own text does not count among its host's. Null
    page_ids and repeated rows stay as they are; no pages, or no labelled text, give no rows; other columns are ignored.
    """
    langs, model = fit(labelled.select("doc_id", "text", "lang"), sample_docs)
    n = len(langs)
    if not n:
        return pages.sparkSession.createDataFrame(
            [], "page_id bigint, lang string, confidence double, text_lang string, declared string, suffix string, host string"
        )
    host = F.lower(F.regexp_extract(text_of("url"), HOST, 1))
    domain = F.substring_index(host, ".", -2)
    declared = F.lower(F.regexp_extract(text_of("html"), DECLARED, 1))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), domain.alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"), declared.alias("declared"),
        page_text(text_of("html")).cast("binary").alias("_text"),
    )
    seen = durable(_text_evidence(rows, model).withColumn("likely", _normal(F.col("evidence"))))
    whole = seen.agg(*[F.sum(F.get("likely", k)) for k in range(n)]).first()
    total = sum(whole) if whole[0] is not None else 0.0
    overall = F.array(*[F.lit(((w or 0.0) + EVEN) / (total + EVEN * n)) for w in whole])

    def leaning(held: Column, above: Column) -> Column:
        pages_held = F.aggregate(held, F.lit(0.0), lambda s, x: s + x)
        return F.transform(held, lambda x, k: (F.greatest(x, F.lit(0.0)) + LEAN * F.get(above, k)) / (pages_held + LEAN))

    def less(held: Column) -> Column:
        return F.transform(held, lambda x, k: F.greatest(x - F.get(F.col("likely"), k), F.lit(0.0)))

    domains = _sums(seen, ["domain"], n).withColumnRenamed("held", "domain_held")
    hosts = _sums(seen, ["host", "domain"], n).withColumnRenamed("held", "host_held")
    places = hosts.join(domains, "domain").select("host", "host_held", "domain_held")

    def sign_table(sign: str) -> DataFrame:
        """log P(sign | language), from all pages: per language the share of its pages that show the sign."""
        shares = F.transform("held", lambda x, k: F.log((x + EVEN * F.get(overall, k)) / (F.get(overall, k) * (total + EVEN))))
        return _sums(seen, [sign], n).select(F.col(sign), shares.alias(f"{sign}_says"))

    joined = (
        seen.join(places, "host").join(sign_table("declared"), "declared").join(sign_table("suffix"), "suffix")
    )
    prior = leaning(less(F.col("host_held")), leaning(less(F.col("domain_held")), overall))
    logs = F.transform("evidence", lambda x, k: (
        x + F.log(F.get("_prior", k)) + F.when(F.col("declared") != "", F.get("declared_says", k)).otherwise(0.0)
        + F.when(F.col("suffix") != "", F.get("suffix_says", k)).otherwise(0.0)
    ))
    fused = joined.withColumn("_prior", F.when(F.col("host") != "", prior).otherwise(overall)).withColumn("_logs", logs)
    chances = fused.withColumn("_chance", _normal(F.transform("_logs", lambda x: x - F.array_max("_logs"))))
    names = F.array(*[F.lit(x) for x in langs])

    def best(values: str) -> Column:
        return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    def or_null(text: str) -> Column:
        return F.when(F.col(text) != "", F.col(text)).alias(text)

    return chances.select(
        "page_id", best("_chance").alias("lang"), F.array_max("_chance").alias("confidence"), best("likely").alias("text_lang"),
        or_null("declared"), or_null("suffix"), or_null("host"),
    )
