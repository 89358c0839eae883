"""Live delivery logs. The same functions take a batch table, whose plan is the stream's without its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from postmill.functions.address import address_key
from postmill.operators.campaigns import mark_sent
from postmill.operators.replies import parse_replies, unexpected_replies


def delivery_rate(
    log: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """``window_start, command, n_attempts, n_failed`` per tumbling window, or sliding with ``slide``."""
    timed = log.withWatermark("ts", lateness) if log.isStreaming else log
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        timed.groupBy(window.alias("_window"), "command")
        .agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(~F.col("is_sent")).alias("n_failed"))
        .select(F.col("_window.start").alias("window_start"), "command", "n_attempts", "n_failed")
    )


def connection_sessions(log: DataFrame, gap: str = "300 seconds", lateness: str = "10 minutes") -> DataFrame:
    """``session_id, started, n_attempts, n_failed``: attempts of one connection with no longer pause than ``gap``.

    Set ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` (``local_session`` does) so that a busy
    connection's attempts are merged before the shuffle.
    """
    timed = log.withWatermark("ts", lateness) if log.isStreaming else log
    return (
        timed.groupBy(F.session_window("ts", gap).alias("_session"), "session_id")
        .agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(~F.col("is_sent")).alias("n_failed"))
        .select("session_id", F.col("_session.start").alias("started"), "n_attempts", "n_failed")
    )


def live_dedup(recipients: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first row per message and address on an endless feed with ``ts``. A batch keeps the earliest ``ts``."""
    keyed = recipients.withColumn("_key", address_key(F.col("address")))
    if recipients.isStreaming:
        return keyed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["message_id", "_key"]).drop("_key")
    first = F.min_by(F.struct(*recipients.columns), F.struct("ts", *[c for c in recipients.columns if c != "ts"]))
    return keyed.groupBy("message_id", "_key").agg(first.alias("_row")).select("_row.*")


def live_unexpected(log: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Attempts whose reply is no success for its command, as they come in."""
    return unexpected_replies(parse_replies(log), expected)


def outbox(stream: DataFrame, log_path: str, sent_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes its attempts to the log and the emails it delivered to the sent table.

    Both writes replace the folder of their own batch number, so a batch run again after a failure leaves no double.
    The list itself is not rewritten: ``current_list`` joins it with the sent table when it is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The log is the batch's only evaluation: what was delivered is read from it.
        log = f"{log_path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        delivered = batch.sparkSession.read.schema(batch.schema).parquet(log).filter("is_sent").select("email").distinct()
        delivered.write.mode("overwrite").parquet(f"{sent_path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_list(mailinglist: DataFrame, sent_path: str) -> DataFrame:
    """The mailing list as of now, with everyone delivered by ``outbox`` marked sent."""
    return mark_sent(mailinglist, mailinglist.sparkSession.read.parquet(sent_path))
