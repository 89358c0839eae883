"""Mailing lists: who is left, one message each, stop at the first failure, mark what went out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_recipients(mailinglist: DataFrame) -> DataFrame:
    """List entries not sent yet."""
    return mailinglist.filter(~F.col("sent"))


def campaign_messages(templates: DataFrame, pending: DataFrame, key: str = "campaign") -> DataFrame:
    """One message per pending entry, with its campaign's template and the entry as the only recipient.

    Spark broadcasts the templates where their size allows, so a campaign may own most of the list.
    """
    return pending.join(templates, key)


def send_until_failure(attempts: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Attempts before the first failed one of their group; the rest counts as never tried.

    The first failure is found by aggregation, so no task has to walk a whole group.
    """
    failed = F.min(F.when(~F.col("is_sent"), F.struct(*order)))
    first = attempts.groupBy(*group).agg(failed.alias("_failed"))
    return (
        attempts.join(first, list(group))
        .filter(F.col("_failed").isNull() | (F.struct(*order) < F.col("_failed")))
        .drop("_failed")
    )


def mark_sent(mailinglist: DataFrame, delivered: DataFrame) -> DataFrame:
    """New list where every entry with a delivered email is sent, whoever's row it is; nothing is ever unset."""
    hits = delivered.select("email").distinct().withColumn("_hit", F.lit(True))
    return (
        mailinglist.join(hits, "email", "left")
        .withColumn("sent", F.coalesce(F.col("sent") | F.col("_hit"), F.col("sent"), F.lit(False)))
        .select(*mailinglist.columns)
    )
