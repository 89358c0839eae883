"""Body texts: line breaks, long lines, wire lines, character sets, header encoding, fingerprints, wrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.arrays import bound, part, running
from postmill.functions.headers import bytes_to_encode, encoding_scheme
from postmill.functions.text import (
    MAX_LINE,
    byte_string,
    canonical_body,
    crlf_breaks,
    has_8bit,
    has_long_line,
    lf_breaks,
    secured,
)
from postmill.operators.messages import clusters


def _occurrences(c: Column, text: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("bigint")


def line_breaks(docs: DataFrame, column: str = "body") -> DataFrame:
    """Add ``n_crlf, n_cr, n_lf`` (lone ones) and ``normalised``, the text with CRLF breaks only."""
    text = F.col(column)
    crlf = _occurrences(text, "\r\n")
    return docs.withColumns(
        {
            "n_crlf": crlf,
            "n_cr": _occurrences(text, "\r") - crlf,
            "n_lf": _occurrences(text, "\n") - crlf,
            "normalised": crlf_breaks(text),
        }
    )


def line_break_profile(docs: DataFrame, by: str = "source", column: str = "body") -> DataFrame:
    return line_breaks(docs, column).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_crlf").alias("n_crlf"),
        F.sum("n_cr").alias("n_cr"),
        F.sum("n_lf").alias("n_lf"),
        F.sum(F.octet_length("normalised").cast("bigint")).alias("normalised_bytes"),
    )


def long_line_profile(docs: DataFrame, by: str = "source", column: str = "body") -> DataFrame:
    """Documents with a line of 1000 bytes or more, by ``by``."""
    return docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(has_long_line(F.col(column))).alias("n_long")
    )


def charset_profile(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), column: str = "body") -> DataFrame:
    """Documents with 8-bit text, their bytes beyond one per character, by ``by``."""
    text = F.col(column)
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(has_8bit(text)).alias("n_8bit"),
        F.sum((F.octet_length(text) - F.length(text)).cast("bigint")).alias("extra_bytes"),
    )


def _splits(line: Column) -> Column:
    """How a byte line is split for the wire: ``soft`` and ``hard`` breaks.

    A line over the limit breaks at the last space within it, which is dropped, else one byte short of it. One fold over the
    lengths of the words: ``at`` is where the open line starts, ``space`` the last space in it (or -1), ``word`` where the next
    word starts. A word's end is a space or the end of the line; whatever lies too far off breaks first.
    """
    lengths = F.transform(F.split(line, " "), lambda w: F.length(w).cast("bigint"))
    return bound(F.struct(lengths.alias("lengths"), F.length(line).cast("bigint").alias("total")), _breaks)


def _breaks(line: Column) -> Column:
    zero, step_back = F.lit(0).cast("bigint"), MAX_LINE - 1
    fields = ("at", "space", "word", "soft", "hard")
    start = F.struct(zero.alias("at"), (zero - 1).alias("space"), *[zero.alias(c) for c in fields[2:]])

    def step(state: Column, length: Column) -> Column:
        end = state["word"] + length
        # The bytes the open line may have up to here: at the end of the line a full one, at a space one less before it.
        room = F.when(end == line["total"], MAX_LINE).otherwise(step_back)

        def broken(near: Column) -> Column:
            over = F.greatest(end - near["at"] - room, zero)
            hard = F.ceil(over / step_back).cast("bigint")
            at = near["at"] + hard * step_back
            return F.struct(
                at.alias("at"), F.when(end > at, end).otherwise(-1).cast("bigint").alias("space"), (end + 1).alias("word"),
                near["soft"].alias("soft"), (state["hard"] + hard).alias("hard"),
            )

        soft = (end - state["at"] > room) & (state["space"] > state["at"])
        return bound(F.struct(
            F.when(soft, state["space"] + 1).otherwise(state["at"]).alias("at"), (state["soft"] + soft.cast("bigint")).alias("soft")
        ), broken)

    return F.aggregate(line["lengths"], start, step)


def wire_line_audit(docs: DataFrame, id_column: str = "message_id", column: str = "body") -> DataFrame:
    """Per body ``n_lines, n_long, n_soft, n_hard, n_dots``: lines, lines to be split, the breaks made, and lines
    whose leading dot is doubled. Bodies are counted in place; no line leaves its row."""
    lines = F.split(byte_string(lf_breaks(F.col(column))), "\n")
    parts = F.transform(F.col("_long"), _splits)

    def total(field: str) -> Column:
        return F.aggregate("_parts", F.lit(0).cast("bigint"), lambda n, p: n + p[field])

    return (
        docs.select(id_column, lines.alias("_lines"))
        .select(
            id_column,
            F.size("_lines").cast("bigint").alias("n_lines"),
            F.size(F.filter("_lines", lambda line: line.startswith("."))).cast("bigint").alias("n_dots"),
            F.filter("_lines", lambda line: F.length(line) > MAX_LINE).alias("_long"),
        )
        .select(id_column, "n_lines", F.size("_long").cast("bigint").alias("n_long"), "n_dots", parts.alias("_parts"))
        .select(id_column, "n_lines", "n_long", "n_dots", total("soft").alias("n_soft"), total("hard").alias("n_hard"))
    )


def wire_line_totals(audit: DataFrame) -> DataFrame:
    counts = ("n_lines", "n_long", "n_dots", "n_soft", "n_hard")
    return audit.agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(c) for c in counts])


def header_encoding_profile(texts: DataFrame, column: str, position: str = "text") -> DataFrame:
    """``scheme, n, n_bytes, n_encoded``: header texts by the encoding chosen for them."""
    line = secured(F.col(column))
    return (
        texts.select(line.alias("_line"))
        .select(
            encoding_scheme(F.col("_line"), position).alias("scheme"),
            F.octet_length("_line").cast("bigint").alias("_bytes"),
            bytes_to_encode(F.col("_line"), position).alias("_need"),
        )
        .groupBy("scheme")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("n_bytes"), F.sum("_need").alias("n_encoded"))
    )


def canonical_fingerprint(docs: DataFrame, column: str = "body") -> DataFrame:
    """Add ``canonical_bytes`` and ``fingerprint``, the base64 SHA-256 of the canonical body."""
    body = canonical_body(F.col(column))
    return docs.withColumns(
        {"canonical_bytes": F.octet_length(body).cast("bigint"), "fingerprint": F.base64(F.unhex(F.sha2(body, 256)))}
    )


def duplicate_bodies(docs: DataFrame, id_column: str = "message_id", column: str = "body") -> DataFrame:
    """Groups of bodies with the same fingerprint: ``fingerprint, n, first_id, last_id``."""
    return clusters(canonical_fingerprint(docs, column), F.col("fingerprint"), id_column)


def _wrapped(width: int):
    """Words joined to lines of at most ``width`` bytes where words allow it, as one text with LF breaks.

    A table of breaks comes first, from the words' lengths alone: ``size`` is that of the open line, and ``fresh`` whether
    the word opens a new one. Then each line is one slice of the words.
    """

    def lines(words: Column) -> Column:
        lengths = F.transform(words, lambda w: F.octet_length(w))
        start = F.struct(F.lit(-1).alias("size"), F.lit(True).alias("fresh"))

        def step(state: Column, length: Column) -> Column:
            # Size -1: no word yet. An empty open line takes any word.
            fresh = (state["size"] < 0) | ((state["size"] > 0) & (state["size"] + 1 + length > width))
            return F.struct(F.when(fresh, length).otherwise(state["size"] + 1 + length).alias("size"), fresh.alias("fresh"))

        breaks = F.transform(running(lengths, start, step), lambda s, k: F.struct(s["fresh"].alias("fresh"), k.alias("k")))
        firsts = F.transform(F.filter(breaks, lambda b: b["fresh"]), lambda b: b["k"])
        return bound(firsts, lambda at: F.array_join(F.transform(at, lambda first, n: F.array_join(
            part(words, first, F.coalesce(F.get(at, n + 1), F.size(words))), " "
        )), "\n"))

    return lines


def reflow(docs: DataFrame, width: int, id_column: str = "message_id", column: str = "body") -> DataFrame:
    """Wrap at spaces to ``width`` bytes, one row per line: ``id, line_no, line``. A longer word stays whole.

    One trailing break is removed first. A width under 1 wraps nothing.
    """
    lf = lf_breaks(F.col(column))
    lines = F.split(F.regexp_replace(lf, r"\n\z", ""), "\n")

    def wrap(line: Column) -> Column:
        return bound(F.split(line, " "), _wrapped(width))

    if width >= 1:
        # Only lines over the width need folding.
        lines = F.transform(lines, lambda line: F.when(F.octet_length(line) > width, wrap(line)).otherwise(line))
    wrapped = F.split(F.array_join(lines, "\n"), "\n")
    return docs.select(id_column, F.posexplode(wrapped).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )
