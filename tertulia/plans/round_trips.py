"""Registered queries that go through files: sources, sinks and jobs, written and read again.

Everything they write is removed once their result, checkpointed, no longer needs it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tertulia.functions.lexicon import spanish_adjectives
from tertulia.operators import ingest
from tertulia.plans import fixtures as fx, jobs
from tertulia.sources import readers, writers
from tertulia.sources.staging import checkpointed, remove, shared_folder

PIECE_CHARS = 2000


@contextmanager
def folder(spark: SparkSession, name: str):
    """A new folder in the shared one; it goes at the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def write_export(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The line fixture as text files, one folder per chat."""
    (
        fx.v_lines(spark, sf_dir).repartitionByRange("chat_id", "seq").sortWithinPartitions("chat_id", "seq")
        .select("chat_id", "value").write.partitionBy("chat_id").text(path)
    )


def message_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as pieces of at most ``PIECE_CHARS`` characters; no timestamp and sender: empty."""
    pieces = ingest.message_pieces(ingest.parse_chat_lines(fx.v_lines(spark, sf_dir)), PIECE_CHARS)
    return pieces.na.fill("", ["timestamp", "sender"])


def csv_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with quotes and line breaks through CSV files that are read in splits."""
    with folder(spark, "csv") as path:
        rows = fx.v_decorated(spark, sf_dir).select(
            "timestamp", F.concat("sender", F.lit(' "x", '), F.col("msg_id").cast("string")).alias("sender"), "message")
        writers.write_csv(rows, path)
        return checkpointed(readers.csv_records(spark, path, readers.MESSAGES_CSV))


def _anonymized(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    write_export(spark, sf_dir, f"{path}/in")
    return jobs.run_anonymize(
        spark, f"{path}/in", f"{path}/out", chat_id=F.col("chat_id"), part=F.col("_metadata.file_name"), max_chars=PIECE_CHARS, hide=False)


def anonymize_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anonymise job on text files: messages put together again from their first pieces and the continued ones."""
    with folder(spark, "job") as path:
        first = _anonymized(spark, sf_dir, path)
        rest = spark.read.parquet(f"{path}/out/continued").groupBy("chat_id", "msg_idx").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("at", "text"))).getField("text"), "\n").alias("rest"))
        return checkpointed(first.join(rest, ["chat_id", "msg_idx"], "left").select(
            "chat_id", "msg_idx", "timestamp", "sender", F.concat_ws("\n", "message", "rest").alias("message")))


def anonymized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's text output, line by line with each line's byte offset in its chat, by the manifest's file order."""
    with folder(spark, "text") as path:
        _anonymized(spark, sf_dir, path)
        manifest = spark.read.parquet(f"{path}/out/text_manifest").select(
            F.col("chat_id").alias("chat"), F.substring_index("path", "/", -1).alias("file"), "offset")
        lines = readers.read_chat_lines(spark, f"{path}/out/text", F.col("chat_id"), F.col("_metadata.file_name"))
        lines = lines.join(manifest, (lines.chat_id == manifest.chat) & (lines.part == manifest.file))
        # Files are bounded (part_bytes), so a window over one is, too.
        before = Window.partitionBy("chat_id", "part").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0))
        return checkpointed(lines.select("chat_id", (F.col("offset") + inside).alias("byte_offset"), "value"))


def kept_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name tables of two runs: first the messages of even number, then all of them; the first run's numbers stay."""
    parsed = ingest.parse_chat_lines(fx.v_lines(spark, sf_dir))
    none = spark.createDataFrame([], jobs.NAMES)
    even = F.floor(F.col("seq") / fx.SEQ_WIDTH) % 2 == 0
    first = checkpointed(ingest.new_pseudonyms(parsed.where(even), none))
    return first.unionByName(ingest.new_pseudonyms(parsed, first))


def features_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features job from CSV to CSV."""
    with folder(spark, "features") as path:
        writers.write_csv(fx.v_messages(spark, sf_dir).select("timestamp", "sender", "message"), f"{path}/in.csv")
        jobs.run_features(spark, f"{path}/in.csv", f"{path}/out")
        kinds = "sender string, total_messages long, total_characters long, avg_message_size double"
        return checkpointed(spark.read.option("header", True).schema(kinds).csv(f"{path}/out"))


def report_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full report per chat, its tables read again: rows and a number of each that its counts give."""
    with folder(spark, "report") as path:
        fx.v_messages(spark, sf_dir).select(
            "chat_id", F.col("msg_id").alias("msg_idx"), "timestamp", "sender", "message").write.parquet(f"{path}/in")
        names = jobs.run_report(spark, f"{path}/in", f"{path}/out", spanish_adjectives(spark))
        read = lambda name: spark.read.parquet(f"{path}/out/{name}")
        counted = {
            "top_active_members": "count", "user_statistics": "total_messages", "messages_by_day": "count", "messages_by_hour": "count",
            "top_words": "count", "top_words_per_member": "count", "term_weights": "count",
        }
        parts = [
            read(name).groupBy("chat_id").agg(F.lit(name).alias("metric"), F.count("*").alias("n_rows"), F.sum(column).cast("long").alias("total"))
            for name, column in counted.items() if name in names
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return checkpointed(out)


QUERIES = {
    "message_pieces": message_pieces,
    "csv_in_splits": csv_in_splits,
    "anonymize_job": anonymize_job,
    "anonymized_text": anonymized_text,
    "kept_pseudonyms": kept_pseudonyms,
    "features_job": features_job,
    "report_job": report_job,
}
