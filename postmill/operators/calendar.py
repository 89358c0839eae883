"""Calendar texts from tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import blank
from postmill.operators.ordered import SEGMENT, ordered_concat

# The lines around the events of a calendar.
HEADER = ("BEGIN:VCALENDAR", "METHOD:PUBLISH", "VERSION:2.0")
PRODUCT = "PRODID:-//postmill//calendar//EN"
FOOTER = "END:VCALENDAR"


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def _one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def calendar_export(events: DataFrame, stamped: str, segment_rows: int = SEGMENT, uid_host: str = "calendar") -> DataFrame:
    """One text per calendar with its events by ``seq``: ``calendar, segment, ics``.

    ``events`` carries ``calendar, seq, start_at, end_at, summary, description, url, uid``; the session runs in UTC.
    ``stamped`` is the DTSTAMP of all events, given so that reruns agree. A blank uid is made from calendar and seq.
    """
    made = F.concat(F.md5(F.concat_ws("/", F.col("calendar").cast("string"), F.col("seq").cast("string"))), F.lit(f"@{uid_host}"))
    entry = F.concat_ws(
        "\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.when(blank(F.col("uid")), made).otherwise(F.col("uid"))),
        F.lit(f"DTSTAMP:{stamped}"),
        F.concat(F.lit("DTSTART:"), _stamp(F.col("start_at"))),
        F.concat(F.lit("DTEND:"), _stamp(F.col("end_at"))),
        F.concat(F.lit("SUMMARY:"), _one_line(F.col("summary"))),
        F.concat(F.lit("DESCRIPTION:"), _one_line(F.col("description"))),
        F.concat(F.lit("URL;VALUE=URI:"), F.col("url")),
        F.lit("END:VEVENT"),
    )
    texts = ordered_concat(
        events.withColumn("_entry", entry), ["calendar"], ["seq"], "_entry", "\n", segment_rows
    )
    name = F.concat(F.lit("X-WR-CALNAME:"), F.col("calendar").cast("string"))
    head = F.concat_ws("\n", *[F.lit(line) for line in HEADER], name, F.lit(PRODUCT))
    whole = F.concat_ws(
        "\n",
        F.when(F.col("segment") == 0, head),
        F.col("text"),
        F.when(F.col("segment") == F.col("segments") - 1, F.lit(FOOTER)),
    )
    return texts.select("calendar", "segment", whole.alias("ics"))
