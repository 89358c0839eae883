"""Where results go: the delivery log and the corpus of rendered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


# CSV that keeps line breaks, quotes, empty texts and nulls apart, for writing and reading.
CSV = {"multiLine": "true", "quoteAll": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "", "header": "true"}


def write_delivery_log(
    events: DataFrame, path: str, fmt: str = "parquet", checkpoint: str | None = None
) -> StreamingQuery | None:
    """Append one row per send attempt, as parquet or csv. A stream needs ``checkpoint`` and gives its query back."""
    if not events.isStreaming:
        events.write.mode("append").format(fmt).options(**CSV if fmt == "csv" else {}).save(path)
        return None
    return (
        events.writeStream.format(fmt).options(**CSV if fmt == "csv" else {}).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_corpus(rendered: DataFrame, path: str, buckets: int = 64) -> None:
    """Store rendered messages, one row per message segment, in ``buckets`` folders by message."""
    bucket = F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")
    rendered.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(path)
