"""Message tables: envelope fields, ids, types, encodings, part layout, sizes and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.address import ascii_address, is_address
from postmill.functions.arrays import bound
from postmill.functions.text import base64_size, blank, byte_string, has_8bit, has_long_line, lf_breaks, trimmed
from postmill.session import small_table

ENVELOPE_FIELDS = ("from_address", "sender", "confirm_to")

# The parts of each message type in order, with the boundary level they stand in. ``parent`` is the level
# a multipart container opens; ``part`` names body texts, containers and the place of the attachments.
LAYOUT = (
    ("plain", 1, "body", 0),
    ("inline", 1, "body", 1),
    ("inline", 2, "inline", 1),
    ("attach", 1, "body", 1),
    ("attach", 2, "attachment", 1),
    ("inline_attach", 1, "multipart/related", 1),
    ("inline_attach", 2, "body", 2),
    ("inline_attach", 3, "inline", 2),
    ("inline_attach", 4, "attachment", 1),
    ("alt", 1, "text/plain", 1),
    ("alt", 2, "text/html", 1),
    ("alt", 3, "text/calendar", 1),
    ("alt_inline", 1, "text/plain", 1),
    ("alt_inline", 2, "multipart/related", 1),
    ("alt_inline", 3, "text/html", 2),
    ("alt_inline", 4, "inline", 2),
    ("alt_attach", 1, "multipart/alternative", 1),
    ("alt_attach", 2, "text/plain", 2),
    ("alt_attach", 3, "text/html", 2),
    ("alt_attach", 4, "attachment", 1),
    ("alt_inline_attach", 1, "multipart/alternative", 1),
    ("alt_inline_attach", 2, "text/plain", 2),
    ("alt_inline_attach", 3, "multipart/related", 2),
    ("alt_inline_attach", 4, "text/html", 3),
    ("alt_inline_attach", 5, "inline", 3),
    ("alt_inline_attach", 6, "attachment", 1),
)


def layout_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, ("message_type", "pos", "part", "level"), LAYOUT)


def validate_envelope_fields(
    messages: DataFrame, pattern: str = "html5", fields: Sequence[str] = ENVELOPE_FIELDS
) -> DataFrame:
    """Add ``bad_field, bad_value``: the first field, in the given order, that holds no valid address.

    Blank fields are skipped; fields are trimmed, and international domains judged in their ASCII form.
    """
    trimmed_fields = messages.withColumns({f: trimmed(F.col(f)) for f in fields}).withColumns(
        {f"_ascii_{f}": ascii_address(trimmed(F.col(f))) for f in fields}
    )

    def failing(field: str) -> Column:
        value = F.col(f"_ascii_{field}")
        bad = ~blank(F.col(field)) & ~is_address(value, pattern)
        return F.when(bad, F.struct(F.lit(field).alias("field"), value.alias("address")))

    judged = trimmed_fields.withColumn("_bad", F.coalesce(*[failing(f) for f in fields]))
    return judged.select(*messages.columns, F.col("_bad.field").alias("bad_field"), F.col("_bad.address").alias("bad_value"))


def default_sender(messages: DataFrame, auto: bool = True) -> DataFrame:
    """Fill a blank ``sender`` from ``from_address`` where ``auto``; add ``envelope_sender``, which always falls back."""
    sender, sent_by = F.col("sender"), trimmed(F.col("from_address"))
    filled = F.when(blank(sender), sent_by).otherwise(sender) if auto else sender
    return messages.withColumn("sender", filled).withColumn(
        "envelope_sender", F.when(F.coalesce(sender, F.lit("")) == "", sent_by).otherwise(sender)
    )


def non_empty_gate(messages: DataFrame, allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split into (messages that may go, messages refused as ``empty_message``)."""
    empty = blank(F.col("body")) & F.lit(not allow_empty)
    return messages.filter(~empty), messages.filter(empty).withColumn("error", F.lit("empty_message"))


def message_ids(messages: DataFrame, host: str = "localhost.localdomain") -> DataFrame:
    """Add ``message_ref``: the given id where it has the form ``<..@..>``, else one made from ``message_id``.

    Made ids are the same on every run, so a rerun after a failure writes the same messages.
    """
    given = F.col("given_id")
    made = F.concat(F.lit("<"), F.md5(F.col("message_id").cast("string")), F.lit(f"@{host}>"))
    kept = F.coalesce(given.rlike(r"(?d)^<.*@.*>\n?\z"), F.lit(False))
    return messages.withColumn("message_ref", F.when(kept, given).otherwise(made))


def attachment_flags(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Add ``has_inline`` and ``has_attachment``."""
    flags = attachments.groupBy("message_id").agg(
        F.bool_or(F.col("disposition") == "inline").alias("has_inline"),
        F.bool_or(F.col("disposition") == "attachment").alias("has_attachment"),
    )
    no = F.lit(False)
    return messages.join(flags, "message_id", "left").withColumns(
        {"has_inline": F.coalesce("has_inline", no), "has_attachment": F.coalesce("has_attachment", no)}
    )


def message_type(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Add the flags and ``message_type``: alt, inline and attach joined by ``_``, or plain."""
    parts = F.concat_ws(
        "_",
        F.when(~blank(F.col("alt_body")), "alt"),
        F.when(F.col("has_inline"), "inline"),
        F.when(F.col("has_attachment"), "attach"),
    )
    return attachment_flags(messages, attachments).withColumn(
        "message_type", F.when(parts == "", "plain").otherwise(parts)
    )


def content_type(messages: DataFrame) -> DataFrame:
    """Add ``full_type``, the Content-Type of a message by its ``message_type``."""
    kind = F.col("message_type")
    own = F.concat(F.col("content_type"), F.lit("; charset="), F.col("charset"))
    return messages.withColumn(
        "full_type",
        F.when(kind == "inline", "multipart/related")
        .when(kind.isin("attach", "inline_attach", "alt_attach", "alt_inline_attach"), "multipart/mixed")
        .when(kind.isin("alt", "alt_inline"), "multipart/alternative")
        .otherwise(own),
    )


def _downgraded(encoding: Column, text: Column, value: Column, ascii_value: str) -> Column:
    return F.when((encoding == "8bit") & ~has_8bit(text), ascii_value).otherwise(value)


def transfer_encoding(messages: DataFrame) -> DataFrame:
    """Add ``body_encoding, body_charset, message_encoding, alt_encoding, alt_charset``.

    ASCII text goes as 7bit. A body with a long line turns the body and the message's own default to quoted-printable,
    and the alternative text starts from that changed default.
    """
    encoding, charset, body, alt = (F.col(c) for c in ("encoding", "charset", "body", "alt_body"))
    qp = F.lit("quoted-printable")
    long_body, long_alt = F.col("_long_body"), F.col("_long_alt")
    marked = messages.withColumns(
        {
            "_long_body": (encoding != "base64") & has_long_line(body),
            "_long_alt": has_long_line(F.coalesce(alt, F.lit(""))),
        }
    )
    default = F.col("message_encoding")
    alt_text = F.coalesce(alt, F.lit(""))
    return (
        marked.withColumns(
            {
                "message_encoding": F.when(long_body, qp).otherwise(encoding),
                "body_encoding": F.when(long_body, qp).otherwise(_downgraded(encoding, body, encoding, "7bit")),
                "body_charset": _downgraded(encoding, body, charset, "us-ascii"),
            }
        )
        .withColumns(
            {
                "alt_encoding": F.when((default != "base64") & long_alt, qp).otherwise(
                    _downgraded(default, alt_text, default, "7bit")
                ),
                "alt_charset": _downgraded(default, alt_text, charset, "us-ascii"),
            }
        )
        .drop("_long_body", "_long_alt")
    )


def part_layout(messages: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """One row per part: ``message_id, message_type, pos, sub, part, level`` in order of (pos, sub).

    ``messages`` carries ``message_type`` and ``ical``. Without ``attachments`` the place of the attachments stays one
    row; with them (``message_id, seq, t1, t2, disposition``) each takes a row of its own, ordered by ``seq, t1, t2``.
    """
    slim = messages.select("message_id", "message_type", "ical")
    placed = slim.join(F.broadcast(layout_table(messages.sparkSession)), "message_type").filter(
        (F.col("part") != "text/calendar") | ~blank(F.col("ical"))
    )
    zero = F.lit(0).cast("bigint")
    columns = ["message_id", "message_type", "pos", "part", "level"]
    if attachments is None:
        return placed.select(*columns, zero.alias("seq"), zero.alias("t1"), zero.alias("t2"))
    texts = placed.filter(~F.col("part").isin("inline", "attachment"))
    slots = placed.filter(F.col("part").isin("inline", "attachment"))
    files = attachments.select("message_id", F.col("disposition").alias("part"), F.col("seq").cast("bigint"), "t1", "t2")
    return texts.select(*columns, zero.alias("seq"), zero.alias("t1"), zero.alias("t2")).unionByName(
        slots.join(files, ["message_id", "part"]).select(*columns, "seq", "t1", "t2")
    )


# Quoted-printable lines end at 75 characters and a =; the bytes sent as they are.
QP_LINE = 75
QP_PLAIN = r"[\t\x20-\x3C\x3E-\x7E]"


def _quoted_line(line: Column, last: Column) -> Column:
    """Bytes of one byte line as quoted-printable, soft breaks included, without its own break.

    Runs of bytes that stay and of bytes that take three characters are counted as wholes: ``at`` is how far the open line has
    come, ``soft`` counts breaks. The last byte may stand one further out. White space at the end is escaped, and a dot alone.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("soft"), F.lit(0).cast("bigint").alias("size"))

    def step(state: Column, run: Column) -> Column:
        n = F.length(run).cast("bigint")
        plain = run.rlike(f"^{QP_PLAIN}")
        here = F.greatest(F.floor((QP_LINE - state["at"]) / 3), F.lit(0)).cast("bigint")
        rest = F.greatest(n - here, F.lit(0).cast("bigint"))
        lines = F.when(plain, F.floor((state["at"] + n - 1) / QP_LINE)).otherwise(F.ceil(rest / (QP_LINE // 3))).cast("bigint")
        at = F.when(plain, state["at"] + n - lines * QP_LINE).when(rest == 0, state["at"] + n * 3).otherwise(
            (rest - (lines - 1) * (QP_LINE // 3)) * 3
        )
        return F.struct(at.alias("at"), (state["soft"] + lines).alias("soft"), (state["size"] + F.when(plain, n).otherwise(n * 3)).alias("size"))

    # A last byte that stays never breaks the line: it is counted apart. White space that ends the text is a byte like any other.
    ends_plain = line.rlike(rf"{QP_PLAIN}\z") & ~(last & line.rlike(r"[\t\x20]\z"))
    escaped = F.when(last, F.regexp_replace(line, r"[\t\x20]\z", "\x01")).otherwise(line)
    body = F.regexp_replace(F.when(ends_plain, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(escaped), r"^\.(?=\x00)", "\x01")
    runs = F.regexp_extract_all(body, F.lit(rf"{QP_PLAIN}+|(?s:(?!{QP_PLAIN}).)+"), F.lit(0))
    final = F.when(~ends_plain, 0).when(line.rlike(r"[\t\x20]\z"), 3).otherwise(1)
    return F.when(line == ".", F.lit(3).cast("bigint")).otherwise(
        bound(F.aggregate(runs, start, step), lambda s: s["size"] + s["soft"] * 3) + final
    )


def quoted_printable_size(text: Column) -> Column:
    """Bytes of a text sent as quoted-printable with CRLF breaks, worked out line by line without encoding it."""

    def total(lines: Column) -> Column:
        sizes = F.transform(lines, lambda line, k: _quoted_line(line, k == F.size(lines) - 1))
        return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda n, size: n + size) + (F.size(lines) - 1) * 2

    return bound(F.split(byte_string(lf_breaks(text)), "\n"), total)


def encoded_size(encoding: Column, n_bytes: Column, text: Column | None = None) -> Column:
    """Bytes of a part as sent. Text parts are measured with CRLF breaks and a final break; others by ``n_bytes``.

    Quoted-printable is null without the text.
    """
    if text is None:
        raw, quoted = n_bytes + 2, F.lit(None).cast("bigint")
    else:
        lf = lf_breaks(text)
        breaks = F.length(lf) - F.length(F.replace(lf, F.lit("\n"), F.lit("")))
        raw = F.octet_length(lf) + breaks + F.when(lf.endswith("\n"), 0).otherwise(2)
        quoted = quoted_printable_size(text)
    return (
        F.when(encoding == "base64", base64_size(n_bytes))
        .when(encoding.isin("7bit", "8bit"), raw.cast("bigint"))
        .when(encoding == "quoted-printable", quoted)
        .when(encoding == "binary", n_bytes)
    )


def message_size(parts: DataFrame, server_size: int | None = None, text: str | None = None) -> DataFrame:
    """``message_id, n_parts, encoded_bytes``, and ``fits`` where the server's SIZE is given (0 sets no limit).

    Parts carry ``message_id, encoding, n_bytes``, and the text of quoted-printable ones in the column ``text``. Only where that is
    missing or null are size and ``fits`` null.
    """
    encoding, n_bytes = F.col("encoding"), F.col("n_bytes")
    quoted = encoding == "quoted-printable"
    size = encoded_size(encoding, n_bytes)
    if text:
        size = F.when(quoted, quoted_printable_size(F.when(quoted, F.col(text)))).otherwise(size)
    sized = parts.select("message_id", quoted.alias("_quoted"), size.alias("_size"))
    unknown = F.coalesce(F.bool_or(F.col("_quoted") & F.col("_size").isNull()), F.lit(False))
    sizes = sized.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.when(~unknown, F.sum("_size")).alias("encoded_bytes")
    )
    if server_size is None:
        return sizes
    return sizes.withColumn("fits", F.when(F.col("encoded_bytes").isNotNull(), F.lit(server_size == 0) | (F.col("encoded_bytes") <= server_size)))


def largest_messages(parts: DataFrame, k: int) -> DataFrame:
    return message_size(parts).orderBy(F.desc("encoded_bytes"), "message_id").limit(k)


def canonical_header(line: Column) -> Column:
    """One header as it is hashed: unfolded, name in lower case, runs of white space one space, value trimmed."""
    unfolded = F.regexp_replace(line, r"\r\n\s+", " ")
    name = F.lower(F.substring_index(unfolded, ":", 1))
    value = F.when(F.instr(unfolded, ":") > 0, F.regexp_replace(unfolded, r"^[^:]*:", "")).otherwise("")
    return F.concat(name, F.lit(":"), trimmed(F.regexp_replace(value, r"\s+", " ")))


def header_fingerprint(*lines: Column) -> Column:
    joined = F.concat_ws("\r\n", *[canonical_header(line) for line in lines])
    return F.base64(F.unhex(F.sha2(joined, 256)))


def duplicate_headers(messages: DataFrame) -> DataFrame:
    """Groups of messages with equal From, To, Date and Subject: ``fingerprint, n, first_id, last_id``.

    ``messages`` carries the header lines ``from_line, to_line, date_line, subject_line``.
    """
    lines = [F.col(c) for c in ("from_line", "to_line", "date_line", "subject_line")]
    return clusters(messages, header_fingerprint(*lines), "message_id")


def clusters(df: DataFrame, fingerprint: Column, id_column: str) -> DataFrame:
    # Counted before the shuffle, so a group of copies of any size travels as one row per map task.
    return (
        df.groupBy(fingerprint.alias("fingerprint"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id")
        )
        .filter("n > 1")
    )


def error_totals(messages: DataFrame, errors: DataFrame) -> DataFrame:
    """Per message ``n_errors, is_error, last_error``; the latest text by ``seq`` wins. Without errors: 0, false and null."""
    totals = errors.groupBy("message_id").agg(F.count(F.lit(1)).alias("_n"), F.max_by("error", "seq").alias("last_error"))
    counted = messages.select("message_id").join(totals, "message_id", "left").withColumn("n_errors", F.coalesce("_n", F.lit(0)))
    return counted.select("message_id", "n_errors", (F.col("n_errors") > 0).alias("is_error"), "last_error")


def custom_headers(headers: DataFrame) -> DataFrame:
    """Split ``raw`` at its first colon into ``name, value``; no colon means a null value. Duplicates stay."""
    parts = F.split("raw", ":", 2)
    return headers.withColumns({"name": trimmed(parts[0]), "value": trimmed(F.get(parts, F.lit(1)))})


def header_frequency(headers: DataFrame) -> DataFrame:
    """``name, n, n_valued, n_values_max``: how often each custom header is set."""
    return custom_headers(headers).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valued"), F.max("value").alias("top_value")
    )
