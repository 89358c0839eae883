"""Recipient lists: hygiene, validity, duplicates, headers, envelopes.

A recipient table is long: ``message_id, kind, address, name`` and the columns that give the order of adding.
Kinds are to, cc, bcc and Reply-To.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.address import PATTERNS, address_key, ascii_address, domain_of, is_address, is_international
from postmill.functions.arrays import bound, settled
from postmill.functions.headers import phrase
from postmill.functions.text import blank, has_break, secured, trimmed
from postmill.operators.ordered import SEGMENT, in_ranges, ordered_concat, running_total, whole_texts
from postmill.session import stored

ORDER = ("kind_rank", "seq", "t1", "t2", "address")
KINDS = ("to", "cc", "bcc", "Reply-To")
REPLY_TO = "Reply-To"

Pattern = str | Callable[[Column], Column]


def _valid(c: Column, pattern: Pattern) -> Column:
    return pattern(c) if callable(pattern) else is_address(c, pattern)


def clean_recipients(df: DataFrame) -> DataFrame:
    return df.withColumns({"address": trimmed(F.col("address")), "name": secured(F.col("name"))})


def with_domain(df: DataFrame) -> DataFrame:
    """Add ``domain``; rows without @ have none and are refused later."""
    return df.withColumn("domain", domain_of(F.col("address")))


def refusal(pattern: Pattern = "html5") -> Column:
    """Why a cleaned recipient is refused; null when it is acceptable. Duplicates are no error and come later."""
    address, kind = F.col("address"), F.col("kind")
    return (
        F.when(F.coalesce(F.instr(address, "@"), F.lit(0)) == 0, "invalid_address")
        .when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "Invalid recipient kind")
        .when(~_valid(address, pattern), "invalid_address")
    )


def validate_addresses(df: DataFrame, pattern: Pattern = "html5") -> tuple[DataFrame, DataFrame]:
    """Split into (valid, refused); the refused rows carry ``reason``."""
    rows = settled(df, "address")
    fit = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) & _valid(F.col("address"), pattern)
    return rows.filter(fit), rows.filter(~fit).withColumn("reason", refusal(pattern))


def _namespace() -> Column:
    return F.col("kind") == REPLY_TO


def _first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    # Spark keeps only each map task's first row per key before the shuffle, so a much repeated key stays cheap.
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def dedup_recipients(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """First use of an address in a message wins, across to, cc and bcc together and whatever its case."""
    rows = df.filter(~_namespace()).withColumn("_key", address_key(F.col("address")))
    return _first_per_key(rows, ["message_id", "_key"], order).drop("_key")


def dedup_reply_to(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The same rule for all kinds, where Reply-To has its own namespace."""
    rows = df.withColumns({"_key": address_key(F.col("address")), "_reply": _namespace()})
    return _first_per_key(rows, ["message_id", "_reply", "_key"], order).drop("_key", "_reply")


def accepted_recipients(df: DataFrame, pattern: Pattern = "html5", order: Sequence[str] = ORDER) -> DataFrame:
    """Who receives each message: cleaned, valid, international domains in ASCII form, each address once."""
    return dedup_idn(df, pattern, order).drop("pass")


def dedup_idn(df: DataFrame, pattern: Pattern = "html5", order: Sequence[str] = ORDER) -> DataFrame:
    """Duplicates with international domains.

    Such addresses wait until all plain ones are handled (``pass`` 1), and take the ASCII form of their domain. So a plain twin
    added later still wins. One look at the rows, one shuffle.
    """
    rows = settled(clean_recipients(df), "address", "name").withColumn("pass", is_international(F.col("address")).cast("int"))
    handled = rows.withColumn("address", ascii_address(F.col("address")))
    valid, _ = validate_addresses(handled, pattern)
    return dedup_reply_to(valid, ["pass", *order])


def reject_reasons(df: DataFrame, pattern: Pattern = "html5") -> DataFrame:
    """``reason, domain, n``: refused rows by first failing rule, and dropped duplicates, by lower-case domain.

    Addresses are judged with their domains in ASCII form. Refused rows and accepted addresses are counted in one grouping, in which
    rows that are refused have no address, so a domain's many refusals are one row per task.
    """
    named = clean_recipients(df).withColumn("address", ascii_address(F.col("address")))
    judged = named.withColumns(
        {"_refused": refusal(pattern), "domain": F.lower(F.coalesce(domain_of(F.col("address")), F.lit("")))}
    )
    fits = F.col("_refused").isNull()
    counted = judged.groupBy(
        "_refused", "domain", F.when(fits, F.col("message_id")).alias("_message"), F.when(fits, _namespace()).alias("_reply"),
        F.when(fits, address_key(F.col("address"))).alias("_key"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    more = counted.select(
        F.coalesce("_refused", F.lit("duplicate")).alias("reason"), "domain", F.when(fits, F.col("_n") - 1).otherwise(F.col("_n")).alias("_n")
    )
    return more.filter("_n > 0").groupBy("reason", "domain").agg(F.sum("_n").alias("n"))


def top_rejected_domains(df: DataFrame, k: int, pattern: Pattern = "html5") -> DataFrame:
    totals = reject_reasons(df, pattern).groupBy("domain").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "domain").limit(k)


def pattern_agreement(df: DataFrame, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """Addresses counted by the verdict of each pattern."""
    verdicts = [is_address(trimmed(F.col("address")), p).cast("bigint").alias(p) for p in patterns]
    return df.select(*verdicts).groupBy(*patterns).agg(F.count(F.lit(1)).alias("n"))


def header_injection_scan(df: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """Values holding a line break: ``(id, field, value, cleaned)``. Such a value must not enter a header or command."""
    long = df.select(id_column, *columns).unpivot([id_column], list(columns), "field", "value")
    return long.filter(has_break(F.col("value"))).withColumn("cleaned", secured(F.col("value")))


def no_recipient_messages(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """Messages without any accepted to, cc or bcc, with the error ``provide_address``. Reply-To does not count."""
    reached = recipients.filter(~_namespace()).select("message_id").distinct()
    return messages.join(reached, "message_id", "left_anti").withColumn("error", F.lit("provide_address"))


def recipient_counts(df: DataFrame) -> DataFrame:
    """Per message the number of recipients of each kind, and of all but Reply-To."""

    def of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return df.groupBy("message_id").agg(
        of("to").alias("n_to"),
        of("cc").alias("n_cc"),
        of("bcc").alias("n_bcc"),
        of(REPLY_TO).alias("n_reply_to"),
        F.count_if(~_namespace()).alias("n_total"),
    )


def formatted(address: Column, name: Column) -> Column:
    """``phrase <address>``, or the bare address where there is no name."""
    shown = bound(secured(name), phrase)
    return F.when(blank(name), secured(address)).otherwise(F.concat(shown, F.lit(" <"), secured(address), F.lit(">")))


def recipient_headers(
    df: DataFrame,
    order: Sequence[str] = ORDER,
    transport: str = "smtp",
    segment_rows: int = SEGMENT,
    messages: DataFrame | None = None,
) -> DataFrame:
    """Address header lines: ``message_id, kind, segment, header``.

    Bcc is written only for transports that read it from the header, To not for the one that writes its own. A message with neither to nor cc gets the
    undisclosed-recipients line; give ``messages`` to include those without any row here. A header of more than
    ``segment_rows`` addresses is given as several segments, to be joined by ``', '``.
    """
    held = address_entries(df, order, transport)
    return address_lines(held, order, segment_rows, messages)


def address_entries(df: DataFrame, order: Sequence[str] = ORDER, transport: str = "smtp") -> DataFrame:
    """``message_id, kind, order..., label, entry``: each recipient as ``recipient_headers`` writes it, stored once; ``label`` and ``entry`` are
    null for kinds that are not written.

    What makes the rows (cleaning, checks, duplicates, formatting) is not worked out again for each use.
    """
    shown = ["cc", REPLY_TO] + (["to"] if transport != "mail" else [])
    shown += ["bcc"] if transport in ("sendmail", "qmail", "mail") else []
    # A name is secured in a column of its own, not in a function over an array as in ``formatted``: Spark compiles none of those.
    named = settled(df.withColumn("_name", secured(F.col("name"))), "_name")
    address = secured(F.col("address"))
    written = F.when(blank(F.col("name")), address).otherwise(F.concat(phrase(F.col("_name")), F.lit(" <"), address, F.lit(">")))
    is_shown = F.col("kind").isin(*shown)
    label = F.when(is_shown, F.when(_namespace(), REPLY_TO).otherwise(F.initcap("kind")))
    return stored(
        named.select(*{c: None for c in ["message_id", "kind", *order]}, label.alias("label"), F.when(is_shown, written).alias("entry"))
    )


def address_lines(
    entries: DataFrame,
    order: Sequence[str] = ORDER,
    segment_rows: int = SEGMENT,
    messages: DataFrame | None = None,
    together: bool = False,
) -> DataFrame:
    """The lines of ``recipient_headers`` from ``address_entries``.

    ``together`` says that no header makes more than one segment. Then all rows of a message go to one task, from which its lines, and
    what they are joined with by message, need no other shuffle.
    """
    columns = ["message_id", "label"], order, "entry", ", "
    written = entries.filter("label is not null")
    if together:
        zero = F.lit(0).cast("bigint")
        texts = whole_texts(written.repartition("message_id"), *columns).withColumn("segment", zero)
    else:
        texts = ordered_concat(written, *columns, segment_rows)
    lines = texts.select(
        "message_id",
        F.col("label").alias("kind"),
        "segment",
        F.when(F.col("segment") == 0, F.concat("label", F.lit(": "), "text")).otherwise(F.col("text")).alias("header"),
    )
    open_to = entries.groupBy("message_id").agg(F.coalesce(F.bool_or(F.col("kind").isin("to", "cc")), F.lit(False)).alias("_open"))
    if messages is not None:
        open_to = messages.select("message_id").distinct().join(open_to, "message_id", "left")
    hidden = open_to.filter(~F.coalesce("_open", F.lit(False))).select(
        "message_id",
        F.lit("To").alias("kind"),
        F.lit(0).cast("bigint").alias("segment"),
        F.lit("To: undisclosed-recipients:;").alias("header"),
    )
    return lines.unionByName(hidden)


def single_to(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """One copy of a message per to recipient: ``message_id, ..., copy_to, copy_name``.

    Every copy also goes to the cc and bcc of its ``message_id``; they are not written out again for each copy.
    """
    to = recipients.filter("kind = 'to'").select(
        "message_id", F.col("address").alias("copy_to"), F.col("name").alias("copy_name")
    )
    return messages.join(to, "message_id")


def recipient_order(df: DataFrame, order: Sequence[str] = ("seq", "t1", "t2", "address")) -> DataFrame:
    """Envelope order: to, then cc, then bcc, each as added. Adds ``position``, from 1.

    Positions are counted per range of rows, so a message with very many recipients is not one task, whatever its ``seq``.
    """
    rank = F.when(F.col("kind") == "to", 0).when(F.col("kind") == "cc", 1).otherwise(2)
    rows = in_ranges(df.filter(~_namespace()).withColumn("_rank", rank), ["message_id"], ["_rank", *order], "_block")
    counted = running_total(rows, ["message_id"], ["_rank", *order], F.lit(1), "_earlier", "_block")
    return counted.withColumn("position", F.col("_earlier") + 1).drop("_rank", "_block", "_earlier")


def envelope(to: DataFrame, cc: DataFrame, bcc: DataFrame) -> DataFrame:
    """All recipients as one list, with their kind."""
    parts = [part.withColumn("kind", F.lit(kind)) for part, kind in ((to, "to"), (cc, "cc"), (bcc, "bcc"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def envelope_rows(df: DataFrame) -> DataFrame:
    """The same from one table that has the kinds already."""
    return df.filter(F.col("kind").isin("to", "cc", "bcc"))


def suppress(df: DataFrame, *kinds: str) -> DataFrame:
    """Drop all recipients of the given kinds, waiting ones included; no kind means all but Reply-To."""
    return df.filter(~F.col("kind").isin(*(kinds or ("to", "cc", "bcc"))))


def parse_address_lists(df: DataFrame, column: str = "addresses", pattern: Pattern = "html5") -> DataFrame:
    """One row per valid address of a comma list: the input's other columns, ``pos, name, address``.

    Every comma splits, also in quotes. With ``<``, the name stands before it and loses its quote marks.
    """
    others = [c for c in df.columns if c != column]
    pieces = df.select(*others, F.posexplode(F.split(column, ",")).alias("pos", "_piece"))
    piece = trimmed(F.col("_piece"))
    halves = F.split(piece, "<")
    named = F.instr(piece, "<") > 0
    address = F.when(named, trimmed(F.translate(F.get(halves, F.lit(1)), ">", ""))).otherwise(piece)
    name = F.when(named, trimmed(F.translate(F.get(halves, F.lit(0)), "\"'", ""))).otherwise(F.lit(""))
    parsed = pieces.select(*others, F.col("pos").cast("bigint").alias("pos"), name.alias("name"), address.alias("address"))
    return parsed.filter(_valid(F.col("address"), pattern))
