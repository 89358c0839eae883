"""Whole messages from tables: header rows, MIME parts, encoded bodies."""

from __future__ import annotations

import quopri

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions.arrays import settled
from postmill.functions.headers import encoded_words
from postmill.functions.text import CRLF, blank, crlf_breaks, has_8bit, secured, trimmed
from postmill.operators.attachments import attachment_dedup
from postmill.operators.messages import LAYOUT, content_type, layout_table, message_ids, message_type, transfer_encoding
from postmill.operators.ordered import SEGMENT, SEGMENT_BYTES, large_groups, ordered_concat, parted, whole_texts
from postmill.operators.recipients import ORDER, address_entries, address_lines, formatted
from postmill.session import stored

# Pieces of one message joined into one text: attachments are large, so segments are shorter than for addresses.
SEGMENT_PIECES = 20_000
PIECE_ORDER = ["pos", "step", "seq", "t1", "t2"]
PREAMBLE = f"This is a multi-part message in MIME format.{CRLF}{CRLF}"

# After which part of each message type which boundary level is closed.
CLOSINGS = (
    ("inline", 2, 1),
    ("attach", 2, 1),
    ("inline_attach", 3, 2),
    ("inline_attach", 4, 1),
    ("alt", 3, 1),
    ("alt_inline", 4, 2),
    ("alt_inline", 4, 1),
    ("alt_attach", 3, 2),
    ("alt_attach", 4, 1),
    ("alt_inline_attach", 5, 3),
    ("alt_inline_attach", 5, 2),
    ("alt_inline_attach", 6, 1),
)
# The order of header lines.
PLACES = {
    "Date": 1, "To": 2, "From": 3, "Cc": 4, "Bcc": 5, "Reply-To": 6, "Subject": 7, "Message-ID": 8, "X-Priority": 9,
    "X-Mailer": 10, "Disposition-Notification-To": 11, "custom": 12, "MIME-Version": 13, "Content-Type": 14,
    "Content-Transfer-Encoding": 15,
}


def rfc_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss xx")


def _mark() -> Column:
    return F.md5(F.col("message_id").cast("string"))


def boundary(level: Column | int, mark: Column | None = None) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.lit("b"), level.cast("string"), F.lit("_"), _mark() if mark is None else mark)


def _only_words(c: Column, position: str, charset: str) -> Column:
    """Encoded words for 8-bit texts, null for others. Only those texts are sent to Python; the rest travels as null."""
    return encoded_words(position, charset)(F.when(has_8bit(c), c))


def _words(c: Column, position: str, charset: str) -> Column:
    """Encoded words for 8-bit texts, others as they are."""
    return F.coalesce(_only_words(c, position, charset), c)


def encode_names(df: DataFrame, column: str = "name", charset: str = "utf-8") -> DataFrame:
    """Display names with 8-bit characters as encoded words."""
    rows = settled(df.withColumn(column, secured(F.col(column))), column)
    return rows.withColumn(column, _words(F.col(column), "phrase", charset))


def _worded(messages: DataFrame, charset: str = "utf-8", **_) -> DataFrame:
    """Messages with ``from_name`` and ``subject`` as header lines have them."""
    return messages.withColumns(
        {
            "from_name": _words(secured(F.col("from_name")), "phrase", charset),
            "subject": _words(secured(F.col("subject")), "text", charset),
        }
    )


def _own_values(
    messages: DataFrame, host: str = "localhost.localdomain", x_mailer: str = "postmill", transport: str = "smtp", **_
) -> tuple[DataFrame, dict[str, Column]]:
    """Typed, encoded and worded messages with what their own header lines need, and the values of those lines by name."""
    kind = F.col("message_type")
    multi = ~kind.isin("plain")
    full = F.when(multi, F.concat(F.col("full_type"), F.lit(f';{CRLF}\tboundary="'), boundary(1), F.lit('"'))).otherwise(
        F.col("full_type")
    )
    encoding = F.col("message_encoding")
    shown_encoding = F.when(F.when(multi, encoding == "8bit").otherwise(encoding != "7bit"), encoding)
    confirm = trimmed(F.col("confirm_to"))
    values = {
        "Date": rfc_date(F.coalesce("sent_at", F.timestamp_seconds(F.lit(0)))),
        "From": formatted(trimmed(F.col("from_address")), F.col("from_name")),
        "Subject": F.when(F.lit(transport != "mail"), F.col("subject")),
        "Message-ID": F.col("message_ref"),
        "X-Priority": F.col("priority").cast("string") if "priority" in messages.columns else F.lit(None).cast("string"),
        "X-Mailer": F.lit(x_mailer.strip() or None).cast("string"),
        "Disposition-Notification-To": F.when(confirm != "", F.concat(F.lit("<"), confirm, F.lit(">"))),
        "MIME-Version": F.lit("1.0"),
        "Content-Type": full,
        "Content-Transfer-Encoding": shown_encoding,
    }
    return message_ids(content_type(messages), host), values


def _entries(recipients: DataFrame, transport: str = "smtp", charset: str = "utf-8", **_) -> DataFrame:
    """The recipients as the address lines write them, stored once."""
    return address_entries(encode_names(recipients, charset=charset), ORDER, transport)


def _addressed(messages: DataFrame, entries: DataFrame, together: bool = False) -> DataFrame:
    """The address lines of ``header_block``."""
    to = address_lines(entries, ORDER, messages=messages, together=together)
    places = F.create_map(*[F.lit(x) for item in PLACES.items() for x in item])
    return to.select(
        "message_id",
        places[F.col("kind")].cast("bigint").alias("pos"),
        F.col("segment").alias("seq"),
        F.col("kind").alias("name"),
        F.when(F.col("segment") == 0, F.regexp_replace("header", "^[^:]*: ", "")).otherwise(F.col("header")).alias("value"),
    )


def _custom(headers: DataFrame, charset: str = "utf-8", **_) -> DataFrame:
    """The custom lines of ``header_block``."""
    return headers.select(
        "message_id",
        F.lit(PLACES["custom"]).cast("bigint").alias("pos"),
        F.col("seq").cast("bigint").alias("seq"),
        trimmed(F.col("name")).alias("name"),
        _words(F.coalesce(trimmed(F.col("value")), F.lit("")), "text", charset).alias("value"),
    )


def header_block(
    messages: DataFrame,
    recipients: DataFrame,
    headers: DataFrame,
    host: str = "localhost.localdomain",
    x_mailer: str = "postmill",
    transport: str = "smtp",
    charset: str = "utf-8",
) -> DataFrame:
    """``message_id, pos, seq, name, value``: the header lines of each message in order of (pos, seq).

    ``messages`` is typed and encoded; ``recipients`` are the accepted ones; ``headers`` are ``message_id, seq, name,
    value``. To is one line of several rows where a message has very many recipients.
    """
    named, values = _own_values(_worded(messages.drop("body", "alt_body", "ical"), charset), host, x_mailer, transport)
    lines = F.array(
        *[
            F.struct(F.lit(PLACES[n]).cast("bigint").alias("pos"), F.lit(n).alias("name"), v.alias("value"))
            for n, v in values.items()
        ]
    )
    own = named.select("message_id", F.inline(lines)).filter("value is not null").select(
        "message_id", "pos", F.lit(0).cast("bigint").alias("seq"), "name", "value"
    )
    addressed = _addressed(messages, _entries(recipients, transport, charset))
    return own.unionByName(addressed).unionByName(_custom(headers, charset))


@F.pandas_udf(StringType())
def _quoted_printable(parts: pd.Series) -> pd.Series:
    def encode(data: bytes | None) -> str | None:
        if data is None:
            return None
        text = quopri.encodestring(data.replace(b"\r\n", b"\n").replace(b"\r", b"\n"), quotetabs=False)
        return text.decode("ascii").replace("\n", "\r\n")

    return parts.map(encode)


def quoted(content: Column, encoding: Column) -> Column:
    """Binary content, quoted-printable as it is sent. That runs in Python and is sent nothing else."""
    own = encoding == "quoted-printable"
    return F.when(own, _quoted_printable(F.when(own, content)).cast("binary")).otherwise(content)


def _encoded(content: Column, encoding: Column) -> Column:
    """``encoded`` for content that has gone through ``quoted``."""
    given = content.cast("string")
    text, ended = crlf_breaks(given), given.endswith("\n") | given.endswith("\r")
    return (
        F.when(encoding == "base64", F.concat(F.base64(content), F.lit(CRLF)))
        .when(encoding.isin("7bit", "8bit"), F.concat(text, F.when(ended, "").otherwise(CRLF)))
        .otherwise(given)
    )


def _lines(*lines: Column) -> Column:
    return F.concat_ws("", *[F.concat(line, F.lit(CRLF)) for line in lines])


def _own_slots() -> dict[str, list[tuple[int, int, str, int]]]:
    """By message type, its body parts and closing boundaries, as ``(pos, step, part, level)``."""
    slots: dict[str, list[tuple[int, int, str, int]]] = {}
    for kind, pos, part, level in LAYOUT:
        slots.setdefault(kind, []).extend([] if part in ("inline", "attachment") else [(pos, 0, part, level)])
    for kind, pos, level in CLOSINGS:
        slots[kind].append((pos, 10 - level, "", level))
    return slots


def _placed(pos: int, step: int, piece: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.lit(pos).cast("bigint").alias("pos"), F.lit(step).cast("bigint").alias("step"), zero.alias("seq"), zero.alias("t1"), zero.alias("t2"),
        piece.alias("piece"),
    )


def sendable(messages: DataFrame, **options) -> DataFrame:
    """Encoded messages (``transfer_encoding``) with names and subject worded and quoted-printable texts as they are sent: all that Python
    makes of a message. Spark knows no more how rows lie once they come from Python, so this goes before they are dealt out."""
    texts = {"body": "body_encoding", "alt_body": "alt_encoding", "ical": "message_encoding"}
    return _worded(messages, **options).withColumns({c: quoted(F.col(c).cast("binary"), F.col(e)).cast("string") for c, e in texts.items()})


def own_texts(messages: DataFrame, **options) -> DataFrame:
    """``message_id, pieces``: a message's own header lines, body parts and boundaries in one row, each as ``pos, step, seq, t1, t2,
    piece``. Made in place, in one look at the messages; nothing is shuffled. Spread messages that lie in few splits.
    """
    return _own_pieces(sendable(messages, **options), **options)


def _own_pieces(messages: DataFrame, **options) -> DataFrame:
    """``own_texts`` of ``sendable`` messages.

    The pieces of each type are written out, not worked out by a function over the type's slots: Spark compiles no such function, nor
    what it holds. The one that is left goes over finished lines. With none, Spark would put all types into one Java method, which is
    too long for Java to compile.
    """
    named, values = _own_values(messages, **options)
    mime = {"body": F.col("content_type"), "text/plain": F.lit("text/plain"), "text/html": F.lit("text/html")}
    mime["text/calendar"] = F.lit("text/calendar; method=REQUEST")
    body = F.col("body"), F.col("body_encoding"), F.col("body_charset")
    sources = {"body": body, "text/html": body, "text/plain": (F.col("alt_body"), F.col("alt_encoding"), F.col("alt_charset"))}
    sources["text/calendar"] = F.when(~blank(F.col("ical")), F.col("ical")), F.col("message_encoding"), F.col("charset")
    contents = {"_body": body, "_alt": sources["text/plain"], "_ical": sources["text/calendar"]}
    held = {"body": "_body", "text/html": "_body", "text/plain": "_alt", "text/calendar": "_ical"}
    rows = named.withColumns(
        {c: _encoded(text.cast("binary"), encoding) for c, (text, encoding, _) in contents.items()}
        | {f"_line{PLACES[n]}": F.concat(F.lit(_line_start(PLACES[n]) + n + ": "), v) for n, v in values.items()} | {"_mark": _mark()}
    )
    rows = settled(rows, "_mark")
    mark = F.col("_mark")

    def piece(pos: int, step: int, part: str, level: int) -> Column:
        start = F.concat(F.lit("--"), boundary(level, mark))
        if step:
            return F.concat(F.lit(CRLF + "--"), boundary(level, mark), F.lit("--" + CRLF))
        if part.startswith("multipart/"):
            text = _lines(
                start, F.lit(f"Content-Type: {part};"), F.concat(F.lit('\tboundary="'), boundary(level + 1, mark), F.lit('"')), F.lit("")
            )
        elif level == 0:
            text = F.col(held[part])
        else:
            _, encoding, charset = sources[part]
            head = _lines(
                start, F.concat(F.lit("Content-Type: "), mime[part], F.lit("; charset="), charset),
                F.when(encoding != "7bit", F.concat(F.lit("Content-Transfer-Encoding: "), encoding)), F.lit(""),
            )
            text = F.concat(head, F.col(held[part]), F.lit(CRLF + CRLF))
        # The preamble comes before the first part of every multipart message.
        return F.concat(F.lit(PREAMBLE), text) if pos == 1 and level > 0 else text

    def parts(slots: list[tuple[int, int, str, int]]) -> Column:
        return F.array(*[_placed(pos, step, F.coalesce(piece(pos, step, part, level), F.lit(""))) for pos, step, part, level in slots])

    shown = F.lit(None)
    for kind, slots in _own_slots().items():
        plain = [s for s in slots if s[2] != "text/calendar"]
        made = parts(slots) if plain == slots else F.when(blank(F.col("ical")), parts(plain)).otherwise(parts(slots))
        shown = F.when(F.col("message_type") == kind, made).otherwise(shown)
    lines = F.filter(F.array(*[_placed(PLACES[n] - 100, 0, F.col(f"_line{PLACES[n]}")) for n in values]), lambda p: p["piece"].isNotNull())
    gap = F.array(_placed(-1, 0, F.lit(CRLF + CRLF)))
    return rows.select("message_id", F.concat(lines, gap, shown).alias("pieces"))


def _line_start(place: int) -> str:
    return CRLF if place > 1 else ""


def attachment_texts(messages: DataFrame, attachments: DataFrame, charset: str = "utf-8") -> DataFrame:
    """Attachment parts, in the same columns. ``attachments`` carries ``message_id, seq, t1, t2, name, mime,
    disposition, encoding, cid, content``."""
    return _file_parts(messages, sendable_files(attachments, charset))


def sendable_files(attachments: DataFrame, charset: str = "utf-8", **_) -> DataFrame:
    """Attachments with quoted-printable content as it is sent, and ``_name``, the name in encoded words where it needs them, else null.

    ``_hash`` and ``_bytes`` are those of the content as given, null where that is still there.
    """
    content, encoding = F.col("content").cast("binary"), F.col("encoding")
    given = {name: F.when(encoding == "quoted-printable", value) for name, value in _identity(content).items()}
    return attachments.withColumns({"_name": _only_words(secured(F.col("name")), "text", charset), "content": quoted(content, encoding)} | given)


def _identity(content: Column) -> dict[str, Column]:
    """Contents are told apart by hash and length, so sort keys stay short."""
    return {"_hash": F.unhex(F.sha2(content, 256)), "_bytes": F.octet_length(content)}


def _file_parts(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """``attachment_texts`` of ``sendable_files``."""
    spark = messages.sparkSession
    slots = layout_table(spark).filter(F.col("part").isin("inline", "attachment")).withColumnRenamed("part", "disposition")
    typed = attachments.join(messages.select("message_id", "message_type"), "message_id").join(
        F.broadcast(slots), ["message_type", "disposition"]
    )
    name, encoding = F.col("_name"), F.col("encoding")
    special = name.rlike(r'[ ()<>@,;:\\"/\[\]?=]')
    shown = F.when(special, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)
    head = _lines(
        F.concat(F.lit("--"), boundary(F.col("level"))),
        F.concat(F.lit("Content-Type: "), F.col("mime"), F.when(blank(name), "").otherwise(F.concat(F.lit('; name="'), name, F.lit('"')))),
        F.when(encoding != "7bit", F.concat(F.lit("Content-Transfer-Encoding: "), encoding)),
        F.when(F.col("disposition") == "inline", F.concat(F.lit("Content-ID: <"), F.col("cid"), F.lit(">"))),
        F.concat(
            F.lit("Content-Disposition: "), F.col("disposition"),
            F.when(blank(name), "").otherwise(F.concat(F.lit("; filename="), shown)),
        ),
        F.lit(""),
    )
    named = typed.withColumn("_name", F.coalesce("_name", secured(F.col("name"))))
    return named.select(
        "message_id", "pos", F.lit(1).cast("bigint").alias("step"), F.col("seq").cast("bigint").alias("seq"), "t1", "t2",
        F.concat(head, _encoded(F.col("content"), encoding), F.lit(CRLF + CRLF)).alias("piece"),
    )


def ready(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Messages with type and encodings, as the renderer wants them."""
    return transfer_encoding(message_type(messages, attachments))


def _distinct_files(attachments: DataFrame) -> DataFrame:
    """``sendable_files`` without identical attachments of a message, and later inline ones of the same cid.

    Where the rows lie by message, both rules hold without another shuffle.
    """
    # Hashes do not compress: most are made after the shuffle.
    marked = attachments.withColumns({name: F.coalesce(F.col(name), value) for name, value in _identity(F.col("content")).items()})
    return attachment_dedup(marked, ["name", "mime", "disposition", "encoding", "cid", "_hash", "_bytes"], ["seq", "t1", "t2"])


def _large_messages(
    messages: DataFrame, entries: DataFrame, headers: DataFrame, attachments: DataFrame, segment_rows: int, **options
) -> DataFrame | None:
    """The messages that may come in several segments, or None, told from what goes into them: no text is made for it.

    In bytes, and no less than the texts take: a piece counts as a segment's bytes shared among its rows, a body as what it takes at
    most in any encoding, a short text as what it takes in encoded words wherever it is written.
    """
    unit = max(1, SEGMENT_BYTES // segment_rows)

    def n_bytes(table: DataFrame, *columns: str) -> Column:
        return sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns if c in table.columns), F.lit(0).cast("bigint"))

    # A message's own lines and parts, at most, and what is fixed in them.
    most = len(PLACES) + max(map(len, _own_slots().values()))
    fixed = 4096 + 16 * sum(len(str(v)) for v in options.values())
    short = ["subject", "from_name", "from_address", "given_id", "confirm_to", "content_type", "charset", "encoding"]
    own = F.lit(most * unit + fixed) + n_bytes(messages, "body", "alt_body", "ical") * 4 + n_bytes(messages, *short) * 16
    line = F.lit(unit + fixed) + n_bytes(headers, "name", "value") * 16
    # An address header has segments of its own: rows that fit here fit one of those.
    entry = F.lit(2 * SEGMENT_BYTES // SEGMENT) + n_bytes(entries, "entry") * 2
    sizes = messages.select("message_id", own.alias("_size")).unionByName(headers.select("message_id", line.alias("_size")))
    sizes = sizes.unionByName(entries.select("message_id", entry.alias("_size")))
    if not attachments.isEmpty():
        part = F.lit(unit + fixed) + n_bytes(attachments, "content") * 4 + n_bytes(attachments, "name", "mime", "disposition", "encoding", "cid") * 16
        files = attachments.select("message_id", part.alias("_size"))
        # A message that is there several times has each of its files as often.
        repeated = stored(messages.groupBy("message_id").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1"))
        if not repeated.isEmpty():
            files = files.join(repeated, "message_id", "left").select("message_id", (F.col("_size") * F.coalesce("_times", F.lit(1))).alias("_size"))
        sizes = sizes.unionByName(files)
    # Address lines, of which there are few, are not counted as pieces above.
    return large_groups(sizes, ["message_id"], F.col("_size"), (segment_rows - len(PLACES)) * unit)


def _pieces(
    messages: DataFrame, entries: DataFrame, headers: DataFrame, attachments: DataFrame, together: bool, **options
) -> DataFrame:
    """``message_id, pieces``: all that makes up the messages, each piece as ``pos, step, seq, t1, t2, piece``.

    ``together`` says that no message makes more than one segment. Then what goes into a message is dealt out by message as it is given,
    all texts are made there, and the pieces lie by message.
    """
    own = sendable(transfer_encoding(messages), **options)
    files, lines = sendable_files(attachments, **options), _custom(headers, **options)
    if together:
        messages, own, files, lines = (t.repartition("message_id") for t in (messages, own, files, lines))
    typed = message_type(own, attachments)
    block = _addressed(messages, entries, together).unionByName(lines)
    # A continued address line goes on in the line of its first segment.
    later = F.col("pos").isin(*[PLACES[n] for n in ("To", "Cc", "Bcc", "Reply-To")]) & (F.col("seq") > 0)
    line = F.when(later, F.concat(F.lit("," + CRLF + " "), F.col("value"))).otherwise(
        F.concat(F.when(F.col("pos") > 1, CRLF).otherwise(""), F.col("name"), F.lit(": "), F.col("value"))
    )
    zero = F.lit(0).cast("bigint")
    top = block.select("message_id", (F.col("pos") - 100).alias("pos"), zero.alias("step"), "seq", zero.alias("t1"), zero.alias("t2"), line.alias("piece"))
    piece = F.coalesce("piece", F.lit("")).alias("piece")
    parts = _file_parts(message_type(messages, attachments), _distinct_files(files))
    single = top.unionByName(parts).select("message_id", F.array(F.struct(*PIECE_ORDER, piece)).alias("pieces"))
    return _own_pieces(typed, **options).unionByName(single)


def render_corpus(
    messages: DataFrame,
    recipients: DataFrame,
    headers: DataFrame,
    attachments: DataFrame,
    segment_rows: int = SEGMENT_PIECES,
    **options,
) -> DataFrame:
    """``message_id, segment, message``: every message whole, in any of the eight types, with CRLF breaks.

    What goes into a message travels as it is given and meets once, on ``message_id``; texts are made there and joined, and are
    neither shuffled nor stored. A message of more than ``segment_rows`` parts and header lines comes in several segments, to be joined
    as they are: only such messages go by ranges, which write their texts. Identical attachments of a message, and later inline ones
    of the same cid, are left out. The tables are read several times: store what is dear.
    """
    tables = messages, _entries(recipients, **options), headers, attachments
    split = [parted(t, ["message_id"], large) for large in [_large_messages(*tables, segment_rows, **options)] for t in tables]
    small = _pieces(*[t for t, _ in split], together=True, **options)
    texts = whole_texts(small, ["message_id"], PIECE_ORDER, "piece", bundle="pieces").withColumn("segment", F.lit(0).cast("bigint"))
    if split[0][1] is not None:
        pieces = _pieces(*[t for _, t in split], together=False, **options)
        long = ordered_concat(pieces, ["message_id"], PIECE_ORDER, "piece", "", segment_rows, bundle="pieces")
        texts = texts.unionByName(long.select(*texts.columns))
    return texts.select("message_id", "segment", F.col("text").alias("message"))


def render_text_messages(messages: DataFrame, recipients: DataFrame, headers: DataFrame, **options) -> DataFrame:
    """Messages without attachments: plain or with an alternative text."""
    files = pa.schema(
        [(c, pa.int64()) for c in ("message_id", "seq", "t1", "t2")]
        + [(c, pa.string()) for c in ("name", "mime", "disposition", "encoding", "cid")]
        + [("content", pa.binary())]
    )
    # As a local table Spark knows that it is empty, and leaves out all that it would be joined with.
    return render_corpus(messages, recipients, headers, messages.sparkSession.createDataFrame(files.empty_table()), **options)
