"""Server replies: assembling, parsing, expected codes, capabilities, outcomes of a delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import trimmed
from postmill.operators.ordered import SEGMENT, in_ranges, ordered_concat, running_total
from postmill.session import small_table

# Reply codes that count as success, by command.
EXPECTED_CODES = {
    "MAIL FROM": (250,),
    "RCPT TO": (250, 251),
    "DATA": (354,),
    "DATA END": (250,),
    "QUIT": (221,),
    "RSET": (250,),
    "EHLO": (250,),
    "HELO": (250,),
    "STARTTLS": (220,),
    "VRFY": (250, 251),
    "NOOP": (250,),
    "SAML": (250,),
    "AUTH": (334, 235),
    "AUTH CRAM-MD5": (334,),
    "AUTH NTLM": (334,),
    "User & Password": (235,),
    "Username": (334, 235),
    "Password": (235,),
}
# Fixed value: login methods, most wanted first.
AUTH_PREFERENCE = ("LOGIN", "CRAM-MD5", "NTLM", "PLAIN", "XOAUTH2")
# What a reply starts with, and what a relay entry looks like.
REPLY_START = r"^([0-9]{3})[ -](?:([0-9]\.[0-9]\.[0-9]) )?"
RELAY_ENTRY = r"^((ssl|tls)://)*([a-zA-Z0-9.-]*):?([0-9]*)\z"


def expected_table(spark: SparkSession) -> DataFrame:
    rows = [(command, code) for command, codes in EXPECTED_CODES.items() for code in codes]
    return small_table(spark, ("command", "code"), rows)


def reply_lines(lines: DataFrame) -> DataFrame:
    """Add ``reply_no`` to server lines ``session_id, line_no, line``: a reply ends at a line whose 4th byte is a space.

    ``line_no`` orders the lines of a session; the count runs per range of rows, so one long session is many tasks.
    """
    ends = (F.substring("line", 4, 1) == " ").cast("bigint")
    blocked = in_ranges(lines, ["session_id"], ["line_no"], "_block")
    return running_total(blocked, ["session_id"], ["line_no"], ends, "reply_no", "_block").drop("_block")


def assemble_replies(lines: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """``session_id, reply_no, first_line_no, command, segment, reply``: the lines of each reply joined by LF.

    A reply of more than ``segment_rows`` lines comes in several segments, each with its own first line number.
    """
    numbered = reply_lines(lines)
    first = F.min("line_no").alias("first_line_no")
    texts = ordered_concat(
        numbered, ["session_id", "reply_no", "command"], ["line_no"], "line", "\n", segment_rows, carry=[first]
    )
    return texts.select("session_id", "reply_no", "first_line_no", "command", "segment", F.col("text").alias("reply"))


def reply_fields(reply: Column) -> dict[str, Column]:
    """``code, code_ex, detail`` of a reply; the detail has the codes cut from every line."""
    parsed = reply.rlike(REPLY_START)
    code = F.when(parsed, F.regexp_extract(reply, REPLY_START, 1)).otherwise(F.left(reply, F.lit(3)))
    extended = F.when(parsed, F.nullif(F.regexp_extract(reply, REPLY_START, 2), F.lit("")))
    more = F.coalesce(F.concat(F.replace(extended, F.lit("."), F.lit("\\.")), F.lit(" ")), F.lit(""))
    cut = F.regexp_replace(reply, F.concat(code, F.lit("[ -]"), more), F.lit(""))
    detail = F.when(parsed, cut).otherwise(F.substring(reply, 5, 2**31 - 1))
    return {"code": code.try_cast("bigint"), "code_ex": extended, "detail": detail}


def parse_replies(replies: DataFrame) -> DataFrame:
    return replies.withColumns(reply_fields(F.col("reply")))


def reply_classes(parsed: DataFrame) -> DataFrame:
    """Replies counted by class (first digit) and enhanced code."""
    return parsed.groupBy(
        F.floor(F.col("code") / 100).cast("bigint").alias("code_class"), F.coalesce("code_ex", F.lit("")).alias("code_ex")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("detail").cast("bigint")).alias("detail_bytes"))


def unexpected_replies(replies: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Replies ``command, code`` that are no success. The built-in table is some twenty rows and is broadcast;
    another table is joined as its size suggests. Works on streams too."""
    known = F.broadcast(expected_table(replies.sparkSession)) if expected is None else expected
    return replies.join(known, ["command", "code"], "left_anti")


def capabilities(ehlo: DataFrame) -> DataFrame:
    """One row per server and extension: ``server, extension, args``.

    ``ehlo`` carries ``server, command, reply``. The first line gives the server's name under EHLO or HELO. SIZE keeps
    its first argument (0 without), AUTH its list, any other extension is just there. A later line of the same
    extension wins.
    """
    lines = ehlo.select("server", "command", F.posexplode(F.split("reply", "\n")).alias("pos", "_line"))
    text = trimmed(F.substring("_line", 5, 2**31 - 1))
    fields = F.split("_text", " ")
    rest = F.slice(fields, F.lit(2), F.size(fields))
    args = (
        F.when(F.col("pos") == 0, F.slice(fields, 1, 1))
        .when(F.col("extension") == "SIZE", F.when(F.size(rest) > 0, F.slice(rest, 1, 1)).otherwise(F.array(F.lit("0"))))
        .when(F.col("extension") == "AUTH", rest)
        .otherwise(F.array(F.lit("true")))
    )
    rows = (
        lines.withColumn("_text", text)
        .filter(~F.col("_text").isin("", "0"))
        .withColumn("extension", F.when(F.col("pos") == 0, F.col("command")).otherwise(fields[0]))
        .withColumn("args", args)
    )
    return rows.groupBy("server", "extension").agg(F.max_by("args", "pos").alias("args"))


def server_caps(caps: DataFrame) -> DataFrame:
    """``server, caps, auth``: all extensions of a server as a map, and the login method chosen for it.

    A server lists a handful of extensions, one per line of its reply, so the map is bounded by that reply.
    """
    offered = F.element_at("caps", "AUTH")
    chosen = F.get(F.filter(F.lit(list(AUTH_PREFERENCE)), lambda p: F.array_contains(offered, p)), F.lit(0))
    return (
        caps.groupBy("server")
        .agg(F.map_from_entries(F.collect_list(F.struct("extension", "args"))).alias("caps"))
        .withColumn("auth", chosen)
    )


def capability_rollup(caps: DataFrame) -> DataFrame:
    """``extension, n_servers``. Each (server, extension) is one row already, so no distinct is needed."""
    return caps.groupBy("extension").agg(F.count(F.lit(1)).alias("n_servers"))


def send_outcome(results: DataFrame) -> DataFrame:
    """Per message ``n_accepted, n_rejected, data_sent, status``. Data goes out when anyone was accepted, but a message
    with rejected recipients still reports a failure: partial."""
    accepted = F.count_if("accepted")
    rejected = F.count_if(~F.col("accepted"))
    return results.groupBy("message_id").agg(
        accepted.alias("n_accepted"),
        rejected.alias("n_rejected"),
        (accepted > 0).alias("data_sent"),
        F.when(rejected == 0, "sent").when(accepted > 0, "partial").otherwise("failed").alias("status"),
    )


def failure_texts(results: DataFrame, order: list[str], segment_rows: int = SEGMENT) -> DataFrame:
    """``message_id, segment, failures``: ``address: detail`` of the rejected recipients, run together in order."""
    bad = results.filter(~F.col("accepted")).withColumn("_text", F.concat("address", F.lit(": "), "detail"))
    return ordered_concat(bad, ["message_id"], order, "_text", "", segment_rows).select(
        "message_id", "segment", F.col("text").alias("failures")
    )


def relay_attempts(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Per message ``connected, host, error``: the first host that worked, else the last error.

    Entries that are no host are skipped and leave no error.
    """
    place = F.struct(*order)
    usable = attempts.withColumn("_entry", F.trim("host").rlike(RELAY_ENTRY))
    worked = F.col("_entry") & F.col("ok")
    failed = F.col("_entry") & ~F.col("ok")
    found = usable.groupBy("message_id").agg(
        F.min_by("host", F.when(worked, place)).alias("host"), F.max_by("error", F.when(failed, place)).alias("_error")
    )
    connected = F.col("host").isNotNull()
    return found.select(
        "message_id", connected.alias("connected"), "host", F.when(~connected, F.col("_error")).alias("error")
    )
