"""Writers: anonymised text, message tables and CSV results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TEXT_BYTES = 128 << 20  # of a part of the text output, about


def write_anonymized_text(
    messages: DataFrame, path: str, by_chat: bool = True, preamble: DataFrame | None = None,
    continued: DataFrame | None = None, part_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """Text lines ``[timestamp] sender: text`` in message order as ``.txt`` files, one folder per chat; returns the manifest.

    ``preamble``: lines that stand before a chat's first message (``ingest.preamble_lines``).  ``continued``: later
    pieces (``chat_id, msg_idx, at, text``) of messages whose first piece is in ``messages``.

    The rows are cut into ranges, as many as their bytes ask for, so a large chat is spread over many files and small
    chats share a task.  The manifest, also written to ``path/_manifest``, has a row per file: chat_id, path, offset and
    bytes; the files of a chat, joined by offset, are its text.
    """
    order = ["chat_id", "msg_idx", "at", "part", "block", "seq"]
    none, zero = F.lit("").alias("part"), F.lit(0).cast("long")
    rows = messages.select(
        "chat_id", "msg_idx", zero.alias("at"), none, zero.alias("block"), zero.alias("seq"),
        F.format_string("[%s] %s: %s", "timestamp", "sender", "message").alias("value"))
    if continued is not None:
        rows = rows.unionByName(continued.select(
            "chat_id", "msg_idx", "at", none, zero.alias("block"), zero.alias("seq"), F.col("text").alias("value")))
    if preamble is not None:
        rows = rows.unionByName(preamble.select(
            "chat_id", zero.alias("msg_idx"), zero.alias("at"), "part", F.col("block").cast("long").alias("block"),
            F.col("seq").cast("long").alias("seq"), F.col("text").alias("value")))
    total = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-total // part_bytes)), *order).sortWithinPartitions(*order)
    # A chat without a name has the folder of NULLs.
    kept = rows.select("chat_id", "value") if by_chat else rows.select("value")
    (kept.write.partitionBy("chat_id") if by_chat else kept.write).mode("overwrite").text(path)
    beside = f"{path.rstrip('/')}_manifest"
    text_manifest(messages.sparkSession, path).coalesce(1).write.mode("overwrite").parquet(beside)
    return messages.sparkSession.read.parquet(beside)


def text_manifest(spark, path: str) -> DataFrame:
    """chat_id, path, offset and bytes of the files of a text output, from the files' own sizes.

    File names follow the order of the ranges they hold, so offsets are sums over a chat's files (files, not lines).
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt")
        .load(path).select("path", F.col("length").alias("bytes"))
    )
    folder = F.regexp_extract("path", "/chat_id=([^/]*)/[^/]*$", 1)
    name = F.when(folder != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))))
    earlier = Window.partitionBy("chat_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return (
        files.withColumn("chat_id", F.when(folder != "", name)).withColumn("file", F.substring_index("path", "/", -1))
        .withColumn("offset", F.coalesce(F.sum("bytes").over(earlier), F.lit(0).cast("long")))
        .select("chat_id", "path", "offset", "bytes").orderBy("chat_id", "offset")
    )


def write_messages(messages: DataFrame, path: str) -> None:
    """Parquet clustered by chat and message number, so both prune row groups."""
    (
        messages.repartitionByRange("chat_id", "msg_idx")
        .sortWithinPartitions("chat_id", "msg_idx")
        .write.mode("overwrite").parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes doubled, as data-frame libraries read them."""
    (
        df.write.mode("overwrite").option("header", True)
        .option("quote", '"').option("escape", '"')
        # Timestamps of messages may end in a blank, which counts.
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
