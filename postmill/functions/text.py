"""Column rules on text. Lengths are in bytes, as mail counts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters trimmed from addresses, names and headers, and the line limit in bytes without its break.
TRIM_CHARS = " \t\n\r\x00\x0b"
MAX_LINE = 998
CRLF = "\r\n"


def blank(c: Column) -> Column:
    """Null, empty and '0' all count as "not given"."""
    return c.isNull() | c.isin("", "0")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def secured(c: Column) -> Column:
    """One header-safe line: no CR or LF, no outer white space."""
    return trimmed(F.translate(c, "\r\n", ""))


def has_break(c: Column) -> Column:
    return c.contains("\n") | c.contains("\r")


def has_8bit(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def byte_string(c: Column) -> Column:
    """One character per byte, for rules that cut or match bytes."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def lf_breaks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def crlf_breaks(c: Column) -> Column:
    return F.replace(lf_breaks(c), F.lit("\n"), F.lit("\r\n"))


def has_long_line(c: Column, limit: int = MAX_LINE + 2) -> Column:
    """A line of ``limit`` bytes or more between LFs; a CR belongs to its line."""
    long_enough = F.octet_length(c) >= limit
    return F.when(
        long_enough, F.exists(F.split(c, "\n"), lambda line: F.octet_length(line) >= limit)
    ).otherwise(F.lit(False))


def canonical_body(c: Column) -> Column:
    """Body as it is hashed for a signature: every LF a CRLF, trailing empty lines cut, never empty."""
    body = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))
    return F.when(c == "", F.lit(CRLF)).otherwise(F.regexp_replace(body, r"(?:\r\n){2,}\z", "\r\n"))


def base64_size(n_bytes: Column, line: int = 76) -> Column:
    """Bytes of a base64 body with a CRLF after every ``line`` characters, the last line included."""
    chars = (F.floor((n_bytes + 2) / 3) * 4).cast("bigint")
    return chars + F.ceil(chars / line).cast("bigint") * 2
