"""Column rules on header texts and their encoding."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions.text import byte_string, has_8bit

# The bytes that need encoding, by position, and the characters a bare phrase may hold.
NEEDS_ENCODING = {
    "text": r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF",
    "comment": r"()\x22\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF",
    "phrase": r"\x00-\x1F\x22\x5C\x7F-\xFF",
}
CONTROLS = (*range(32), 127)
CONTROL_LETTERS = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}
PLAIN_PHRASE = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~ -]*\z"


def _control_escape(char: Column) -> Column:
    """A control character as backslash and letter, or as three octal digits."""
    octal = F.lpad(F.conv(F.ascii(char).cast("string"), 10, 8), 3, "0")
    letters = F.create_map(*[F.lit(x) for code, letter in CONTROL_LETTERS.items() for x in (chr(code), letter)])
    return F.concat(F.lit("\\"), F.coalesce(letters[char], octal))


def bytes_to_encode(c: Column, position: str = "text") -> Column:
    """Bytes of a header text that need encoding."""
    return F.length(F.regexp_replace(byte_string(c), f"[^{NEEDS_ENCODING[position]}]+", "")).cast("bigint")


def encoding_scheme(c: Column, position: str = "text") -> Column:
    """none, B (more than a third of the bytes need encoding) or Q. A phrase without 8-bit bytes is quoted instead."""
    need = F.when(has_8bit(c) | F.lit(position != "phrase"), bytes_to_encode(c, position)).otherwise(0)
    return F.when(need == 0, "none").when(need * 3 > F.octet_length(c), "B").otherwise("Q")


def phrase(c: Column) -> Column:
    """A display name as written in a header. ASCII names only; see ``encoded_words`` for others."""
    escaped = F.regexp_replace(c, r"[\\\"]", r"\\$0")
    codes = F.lit([chr(code) for code in CONTROLS])
    controls = F.aggregate(codes, escaped, lambda text, code: F.replace(text, code, _control_escape(code)))
    escaped = F.when(c.rlike(r"[\x00-\x1F\x7F]"), controls).otherwise(escaped)
    return F.when(has_8bit(c) | c.rlike(PLAIN_PHRASE), c).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def _words(text: str, position: str, charset: str) -> str:
    data = text.encode("utf-8")
    plain = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!*+/-") if position == "phrase" else (
        set(range(33, 127)) - set(b"=?_")
    )
    needed = sum(b > 126 or (b < 32 and b not in (9, 10, 13)) or (position == "phrase" and b in b'"\\\t') for b in data)
    if not needed:
        return text
    scheme = "B" if needed * 3 > len(data) else "Q"

    def encode(part: str) -> str:
        if scheme == "B":
            return base64.b64encode(part.encode("utf-8")).decode("ascii")
        return "".join(chr(b) if b in plain else "_" if b == 32 else f"={b:02X}" for b in part.encode("utf-8"))

    # A word's length is added up character by character: bytes for B, written characters for Q.
    room = 75 - 7 - len(charset)
    words, part, size = [], "", 0
    for char in text:
        own = len(char.encode("utf-8")) if scheme == "B" else len(encode(char))
        if part and (-(-(size + own) // 3) * 4 if scheme == "B" else size + own) > room:
            words.append(part)
            part, size = "", 0
        part, size = part + char, size + own
    words.append(part)
    return "\r\n ".join(f"=?{charset}?{scheme}?{encode(w)}?=" for w in words)


def encoded_words(position: str = "text", charset: str = "utf-8"):
    """Arrow function giving header texts as encoded words of at most 75 characters; ASCII texts stay as they are."""

    @F.pandas_udf(StringType())
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else _words(t, position, charset))

    return encode
