"""Line dedup with levelled sorted runs of line hashes.

The documents come in batches. A batch first loses the lines the runs already know to be common, by a merge anti-join, and then
adds the counts of its other lines as a sorted run of its own. A level that has ``FANOUT`` runs is merged into one run of the
next level, so every hash is rewritten once per level. After the last batch the runs tell which lines are common; documents
lose those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import ascii_lower, let, stripped, text_of
from postmill.session import shared_dir

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
# A common line's occurrences are spread over this many keys when they meet the list of common lines.
SALTS = 32


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Per line of a text, in order: 128 bits of hash of its key as two longs, or null where the key is shorter than ``min_chars``.

    Whole texts are lower-cased once, before they are cut.
    """
    def hashed(line: Column) -> Column:
        key = stripped(line)
        pair = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))
        return F.when(F.char_length(key) >= min_chars, pair)

    return F.transform(F.split(ascii_lower(text), "\n"), hashed)


class LineRuns:
    """Sorted runs of ``(a, b, n)``: a line's hash and in how many documents it was found. Kept as Parquet in a shared folder."""

    def __init__(self, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.folder, self.min_docs, self.fanout = folder, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.written = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _store(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{self.written}-level-{level}"
        self.written += 1
        rows.repartition("a").sortWithinPartitions("a", "b").write.parquet(path)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(rows.sparkSession.read.parquet(path))

    def counts(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Add ``(a, b, n)`` of a batch whose documents no earlier batch had."""
        fresh = batch
        for run in self.runs():
            known = run.filter(F.col("n") >= self.min_docs)
            fresh = fresh.join(known, ["a", "b"], "left_anti")
        self._store(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.counts(self.levels[level])
            self.levels[level] = []
            self._store(merged, level + 1)
            level += 1

    def common(self) -> DataFrame:
        """``(a, b)`` of the lines found in at least ``min_docs`` documents."""
        return self.counts(self.runs()).filter(F.col("n") >= self.min_docs).select("a", "b")


def common_lines(
    rows: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``(a, b)`` of the lines of ``(doc_id, text)`` found in at least ``min_docs`` different documents, by runs over ``batches``."""
    folder = shared_dir(rows.sparkSession)
    own = F.filter(F.array_distinct(line_hashes(F.col("text"), min_chars)), lambda h: h.isNotNull())
    found = rows.select("doc_id", F.explode(own).alias("h")).select("doc_id", "h.a", "h.b").distinct()
    counted = found.groupBy(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), "a", "b"
    ).agg(F.count(F.lit(1)).alias("n"))
    counted.repartition("a").sortWithinPartitions("batch", "a", "b").write.partitionBy("batch").parquet(f"{folder}/batches")
    read = rows.sparkSession.read.schema("a long, b long, n long, batch int").parquet(f"{folder}/batches")
    runs = LineRuns(folder, min_docs, fanout)
    for batch in range(batches):
        runs.add(read.filter(F.col("batch") == batch).select("a", "b", "n"))
    return runs.common()


def without_lines(lines: Column, dropped: Column) -> Column:
    """``lines`` without the positions in the sorted array ``dropped``: the stretches between two of them, one after the other."""

    def cut(both: Column) -> Column:
        edge, line = both["edges"], both["lines"]
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(edge) - 1),
            lambda k: F.slice(line, F.get(edge, k - 1) + 2, F.get(edge, k) - F.get(edge, k - 1) - 1),
        ))

    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    return let(F.struct(edges.alias("edges"), lines.alias("lines")), cut)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, **settings) -> DataFrame:
    """``docs`` with ``text`` freed of common lines and the columns ``_n_lines`` and ``_n_dropped`` (longs).

    A line's key is the line without white space at its ends and with A-Z in lower case. Null and empty texts are one empty
    line, whose key is too short to count. Rows with one doc_id (null is one) are one document when lines are counted, and each
    keeps its own rest. An empty table gives no rows; all other columns pass through, but for those of these two names, which give way.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    common = common_lines(docs.select(ids.alias("doc_id"), text_of("text").alias("text")), min_docs, min_chars, **settings)
    # Document and text together name the row: copies of a text lie in different tasks, and repeated rows drop the same lines.
    mark = [F.xxhash64(ids, text_of("text")), F.xxhash64(F.lit("text"), ids, text_of("text"))]
    texts = docs.select(mark[0].alias("_m1"), mark[1].alias("_m2"), text_of("text").alias("_text"))
    salt = F.pmod(F.xxhash64("_m1", "_at"), F.lit(SALTS)).alias("_salt")
    lines = texts.select("_m1", "_m2", F.posexplode(line_hashes(F.col("_text"), min_chars)).alias("_at", "_h"))
    lines = lines.filter("_h is not null").select("_m1", "_m2", "_at", F.col("_h.a").alias("a"), F.col("_h.b").alias("b"), salt)
    salted = common.select("a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
    hit = lines.join(salted, ["a", "b", "_salt"], "left_semi")
    gone = hit.groupBy("_m1", "_m2").agg(F.array_sort(F.collect_set("_at")).alias("_gone"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), mark[0].alias("_m1"), mark[1].alias("_m2"))
    cut = F.split(text_of("_row.text"), "\n")
    both = named.join(gone, ["_m1", "_m2"], "left")
    fields = [
        F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(without_lines(cut, F.col("_gone")), "\n")).alias("text")
        if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_n_lines", "_n_dropped")
    ]
    return both.select(
        *fields, F.size(cut).cast("bigint").alias("_n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("_n_dropped"),
    )
