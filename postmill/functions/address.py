"""Column rules on mail addresses."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions.text import byte_string, has_8bit, has_break

# The address patterns, which decide who is accepted. Both are matched against one character per byte.
HTML5 = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]++@(?>[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)"
    r"(?:\.(?>[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?))*+\z"
)
PCRE = (
    r'(?is)^(?!(?>"?(?>\\[ -~]|[^"])"?){255,})(?!(?>"?(?>\\[ -~]|[^"])"?){65,}@)'
    r'''(?>[!#-'*+/-9=?^-~-]+|"(?>(?>[\x01-\x08\x0B\x0C\x0E-!#-\[\]-\x7F]|\\[\x00-\xFF]))*")'''
    r'''(?>\.(?>[!#-'*+/-9=?^-~-]+|"(?>(?>[\x01-\x08\x0B\x0C\x0E-!#-\[\]-\x7F]|\\[\x00-\xFF]))*"))*'''
    r"@(?>(?![a-z0-9-]{64,})(?>[a-z0-9](?>[a-z0-9-]*[a-z0-9])?)"
    r"(?>\.(?![a-z0-9-]{64,})(?>[a-z0-9](?>[a-z0-9-]*[a-z0-9])?)){0,126}"
    r"|\[(?:(?>IPv6:(?>(?>[a-f0-9]{1,4})(?>:[a-f0-9]{1,4}){7}"
    r"|(?!(?:.*[a-f0-9][:\]]){8,})(?>[a-f0-9]{1,4}(?>:[a-f0-9]{1,4}){0,6})?"
    r"::(?>[a-f0-9]{1,4}(?>:[a-f0-9]{1,4}){0,6})?))"
    r"|(?>(?>IPv6:(?>[a-f0-9]{1,4}(?>:[a-f0-9]{1,4}){5}:"
    r"|(?!(?:.*[a-f0-9]:){6,})(?>[a-f0-9]{1,4}(?>:[a-f0-9]{1,4}){0,4})?"
    r"::(?>(?:[a-f0-9]{1,4}(?>:[a-f0-9]{1,4}){0,4}):)?))?"
    r"(?>25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?>\.(?>25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}))\])\z"
)

# Longer texts are no address under ``pcre``, whose own limit is 254 characters, quotes and escapes apart: the pattern recurses.
MOST_BYTES = 1024

PATTERNS = ("html5", "pcre", "noregex")


def is_address(c: Column, pattern: str = "html5") -> Column:
    """Whether a text is an address under ``pattern``; ``auto`` is ``pcre``. A line break always refuses."""
    if pattern == "html5":
        matches = c.rlike(HTML5)  # no part of it takes a line break
    elif pattern in ("pcre", "auto"):
        short = F.when(F.octet_length(c) <= MOST_BYTES, byte_string(c))
        matches = ~has_break(c) & F.coalesce(short.rlike(PCRE), F.lit(False))
    elif pattern == "noregex":
        at = F.instr(c, "@")
        matches = ~has_break(c) & (F.octet_length(c) >= 3) & (at >= 2) & (at != F.length(c))
    else:
        raise ValueError(f"unknown address pattern: {pattern}")
    return F.coalesce(matches, F.lit(False))


def domain_of(c: Column) -> Column:
    """Text after the last @; null where there is none."""
    return F.when(F.instr(c, "@") > 0, F.substring_index(c, "@", -1))


def address_key(c: Column) -> Column:
    return F.lower(c)


@lru_cache(maxsize=1 << 16)
def _converted(domain: str) -> str:
    try:
        return domain.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return domain


@F.pandas_udf(StringType())
def _ascii_domain(domains: pd.Series) -> pd.Series:
    return domains.map(lambda d: d if d is None else _converted(d))


def is_international(c: Column) -> Column:
    """Whether the domain of an address has 8-bit characters."""
    return F.coalesce(has_8bit(c) & has_8bit(domain_of(c)), F.lit(False))


def ascii_address(c: Column) -> Column:
    """An address with an international domain in its ASCII form; a domain that cannot be converted stays as it is.

    Only such domains are sent to Python, all other rows send null: no second look at the input, no join, no shuffle.
    """
    foreign = F.when(is_international(c), domain_of(c))
    head = F.left(c, F.length(c) - F.length(domain_of(c)))
    return F.coalesce(F.concat(head, _ascii_domain(foreign)), c)
