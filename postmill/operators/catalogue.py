"""Message catalogues: texts by language and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LANG = "en"


def latest_translations(lines: DataFrame) -> DataFrame:
    """One text per language and key from ``lang, line_no, message_key, message``; a later line wins."""
    return lines.groupBy("lang", "message_key").agg(F.max_by("message", "line_no").alias("message"))


def localise(
    errors: DataFrame,
    translations: DataFrame,
    default_lang: str = DEFAULT_LANG,
    help_key: str = "smtp_connect_failed",
    help_text: str = "",
) -> DataFrame:
    """Add ``text``: the key's text in the row's language, else in the default language, else the key itself.

    ``help_text`` is added to the text of ``help_key``. Spark broadcasts the catalogue where its size allows.
    """
    own = translations.select("lang", "message_key", F.col("message").alias("_own"))
    default = translations.filter(F.col("lang") == default_lang).select(
        "message_key", F.col("message").alias("_default")
    )
    known = F.coalesce("_own", "_default")
    suffix = F.when((F.col("message_key") == help_key) & known.isNotNull(), help_text).otherwise("")
    return (
        errors.join(own, ["lang", "message_key"], "left")
        .join(default, "message_key", "left")
        .withColumn("text", F.concat(F.coalesce(known, "message_key"), suffix))
        .drop("_own", "_default")
    )


def translation_coverage(translations: DataFrame, default_lang: str = DEFAULT_LANG) -> DataFrame:
    """``lang, message_key, problem``: keys missing against the default language, and extra ones.

    A language's keys are gathered and taken from the default language's: only what is missing becomes a row. Both sets are bounded
    by what a catalogue holds, not by the number of languages.
    """
    pairs = translations.select("lang", "message_key").distinct()
    wanted = pairs.filter(F.col("lang") == default_lang).select("message_key")
    others = pairs.filter(F.col("lang") != default_lang)
    extra = others.join(wanted, "message_key", "left_anti").withColumn("problem", F.lit("extra"))
    keys = wanted.agg(F.array_sort(F.collect_set("message_key")).alias("_wanted"))
    held = others.groupBy("lang").agg(F.collect_set("message_key").alias("_held"))
    missing = held.select("lang", F.explode(F.array_except(keys.scalar(), F.col("_held"))).alias("message_key"))
    return missing.withColumn("problem", F.lit("missing")).unionByName(extra.select("lang", "message_key", "problem"))
