"""Masking on a stream: the same column expression, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tertulia.functions.redaction import redact_text


def redact_stream(messages: DataFrame, text: str = "message", **options) -> DataFrame:
    """A streaming (or batch) table with its text column masked."""
    return messages.withColumn(text, redact_text(F.col(text), **options))


def start_redaction(messages: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Masks what has arrived, writes Parquet once per row, and ends."""
    return (
        redact_stream(messages, **options)
        .writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
