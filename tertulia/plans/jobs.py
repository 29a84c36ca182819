"""Jobs: anonymise exports, user statistics, full report.

    python -m tertulia.plans.jobs anonymize IN OUT
    python -m tertulia.plans.jobs features IN OUT
    python -m tertulia.plans.jobs report MESSAGES OUT
"""

from __future__ import annotations

import logging
import sys
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tertulia.functions.lexicon import spanish_adjectives
from tertulia.functions.redaction import redact_text
from tertulia.operators import content, ingest, members, temporal, tokens
from tertulia.plans.session import build_session
from tertulia.sources import readers, writers
from tertulia.sources.staging import Staged

log = logging.getLogger("tertulia")


def hidden_name(chat_id: Column) -> Column:
    """A chat's name for output: exports are often named after a person."""
    return F.concat(F.lit("chat_"), F.substring(F.sha2(F.coalesce(chat_id.cast("string"), F.lit("")), 256), 1, 16))


def run_anonymize(
    spark: SparkSession, source, target: str, redact=redact_text, model=None, chat_id=None, part=None,
    max_chars: int = 1 << 24, hide: bool = True, names_table: str | None = None, **names
) -> DataFrame:
    """Exports to ``target/messages`` (Parquet) and ``target/text``; returns the messages.

    A message of more than ``max_chars`` characters (an export whose header form changes is one) has its first piece in
    ``messages`` and the others, in order, in ``target/continued``; the text output holds all of it.

    ``names_table``: a folder that keeps (chat_id, sender, pseudonym, number) between runs; it holds real names.  Senders
    in it keep their pseudonyms, new ones are numbered behind them and appended.

    Chats are named by a hash of what named them (the path by default), unless ``hide`` is False.  Masked lines, then numbered messages, are
    staged so that masking and assembly run once however often the rows are read; all stages
    are deleted at the end (they hold the senders' real names).
    """
    raw = readers.read_chat_lines(spark, source, chat_id, part)
    if hide:
        raw = raw.withColumn("chat_id", hidden_name(F.col("chat_id")))
    with Staged(ingest.masked_lines(raw, redact, model), "lines") as lines:
        with Staged(ingest.message_pieces(lines, max_chars), "assembled") as pieces:
            aliases = ingest.pseudonyms_of_lines(lines, **names) if names_table is None else _kept_names(spark, lines, names_table, names)
            first = pieces.where(F.col("at") == 0).select("chat_id", "msg_idx", "timestamp", "sender", F.col("text").alias("message"))
            # Staged, the names have a size before the messages are joined with them: few enough, they move no text.
            with Staged(aliases, "names") as few:
                writers.write_messages(ingest.pseudonymize_senders(first, few), f"{target}/messages")
            rest = pieces.where(F.col("at") > 0).select("chat_id", "msg_idx", "at", "text")
            rest.repartitionByRange("chat_id", "msg_idx", "at").sortWithinPartitions("chat_id", "msg_idx", "at").write.mode(
                "overwrite").parquet(f"{target}/continued")
        messages = readers.read_messages(spark, f"{target}/messages")
        with Staged(ingest.early_blocks(lines), "early") as early:
            writers.write_anonymized_text(
                messages, f"{target}/text", preamble=ingest.preamble_lines(lines, early), continued=spark.read.parquet(f"{target}/continued"))
    return messages


NAMES = "chat_id string, sender string, pseudonym string, number long"


def _kept_names(spark: SparkSession, lines: DataFrame, path: str, options: dict) -> DataFrame:
    """The kept name table after the senders it lacks were appended."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    known = spark.read.schema(NAMES).parquet(path) if there else spark.createDataFrame([], NAMES)
    # Appended in one commit: a run that fails later finds its names again.
    ingest.new_pseudonyms(lines, known, **options).write.mode("append").parquet(path)
    return spark.read.schema(NAMES).parquet(path)


def read_table(spark: SparkSession, source: str, multi_line: bool = True) -> DataFrame:
    """A message table: CSV where the name ends so, else Parquet."""
    if source.rstrip("/").lower().endswith(".csv"):
        return readers.read_messages_csv(spark, source, multi_line=multi_line)
    return readers.read_messages(spark, source)


def run_features(spark: SparkSession, source: str, target: str, multi_line: bool = True) -> DataFrame:
    """User statistics of a message table (CSV or Parquet), written as CSV.

    ``multi_line``: quoted fields may hold line breaks.
    """
    stats = members.user_statistics(read_table(spark, source, multi_line), null_text="nan")
    writers.write_csv(stats, target)
    return stats


# A task that counts words holds nearly each of its rows, so a part of more bytes would not fit the memory of a core.
PART_BYTES = 16 << 20


@contextmanager
def bounded_parts(spark: SparkSession, df: DataFrame):
    """While the body runs, tables are read and shuffled in parts whose size does not grow with ``df``: never larger or fewer than set."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    number = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    given = spark.conf.get(number, None)
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(given or spark.conf.get("spark.sql.shuffle.partitions")), 2 * read // PART_BYTES)
    before = {number: given}
    spark.conf.set(number, str(parts))
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        before[name] = spark.conf.get(name)
        spark.conf.set(name, f"{min(size(before[name]), PART_BYTES)}b")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_report(
    spark: SparkSession, source: str, target: str, lexicon: DataFrame | None = None, by=("chat_id",)
) -> list[str]:
    """Every metric of a Parquet message table as ``target/<name>`` (Parquet).

    Per chat by default, since pseudonyms start anew in each: two chats' first members are different people.
    ``by=()`` reports over all chats.  The messages are read twice: once into a small table of sizes and
    moments that the member and calendar metrics share, once into words, emojis and links.
    """
    messages = readers.read_messages(spark, source)
    with bounded_parts(spark, messages):
        return _report(spark, messages, target, lexicon, by)


def _report(spark: SparkSession, messages: DataFrame, target: str, lexicon: DataFrame | None, by) -> list[str]:
    keys = list(dict.fromkeys([*by, "sender"]))
    narrow = temporal.with_moment(messages).select(
        *keys, F.col("moment").alias("timestamp"), F.when(F.col("message").isNotNull(), F.lit("")).alias("message"),
        members.message_size(messages, reuse=False).alias("message_size"), members.word_count(messages).alias("word_count"))
    with Staged(narrow, "sizes") as sizes:
        tables = {
            "top_active_members": members.top_active_members(sizes, by=by),
            "avg_user_word_count": members.avg_user_word_count(sizes, by=by),
            "user_statistics": members.user_statistics(sizes, by=by, ordered=False, reuse=True),
            "users_short_messages": members.users_short_messages(sizes, 5, by=by),
            "message_size_boxplot": members.message_size_boxplot(sizes, by=by, reuse=True),
            "participation_profile": members.participation_profile(sizes, by=by, reuse=True),
            "messages_by_day": temporal.messages_by_day(sizes, by=by),
            "messages_by_hour": temporal.messages_by_hour(sizes, by=by),
            "activity_heatmap": temporal.activity_heatmap(sizes, by=by),
            "activity_peaks": temporal.activity_peaks(sizes, by=by),
            "date_range": temporal.date_range(sizes, by=by),
        }
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}")
    for name, metric in (("emoji_frequency", content.emoji_frequency), ("top_shared_domains", content.top_shared_domains)):
        metric(messages, by=by).write.mode("overwrite").parquet(f"{target}/{name}")
    # Cleaning is the costly part: the words are written once and every text metric reads them.
    tokens.tokenize(messages).drop("message", "timestamp").write.mode("overwrite").option("parquet.block.size", PART_BYTES).parquet(f"{target}/words")
    words = spark.read.parquet(f"{target}/words")
    # Counted once per member; coarser groups are sums of these counts.
    with Staged(tokens.token_counts(words, keys), "said") as said, Staged(tokens.token_counts(said, by), "told") as told:
        texts = {
            "top_words": tokens.top_words(told, by=by),
            "top_words_per_member": tokens.top_words_per_member(said, by=by),
            "adjective_frequency": content.adjective_frequency(told, spanish_adjectives(spark) if lexicon is None else lexicon, by=by),
        }
        for name, df in texts.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}")
    with Staged(content.word_and_pair_counts(words, by=by), "counts") as counts, Staged(content.unigrams(counts, by), "unigrams") as single:
        with Staged(content.collocated_pairs(counts, single, by), "pairs") as pairs:
            clouds = {
                "term_weights": content.term_weights(counts, unigrams=single, by=by, pairs=pairs),
                "bigram_collocations": content.bigram_collocations(counts, unigrams=single, by=by, pairs=pairs),
            }
            for name, df in clouds.items():
                df.write.mode("overwrite").parquet(f"{target}/{name}")
    if spark.read.parquet(f"{target}/top_words").isEmpty():
        log.warning("no text is left after cleaning")
    return [*tables, "emoji_frequency", "top_shared_domains", "words", *texts, *clouds]


def main(argv: list[str]) -> int:
    jobs = {"anonymize": run_anonymize, "features": run_features, "report": run_report}
    if len(argv) != 3 or argv[0] not in jobs:
        print(__doc__, file=sys.stderr)
        return 2
    jobs[argv[0]](build_session(f"tertulia-{argv[0]}"), argv[1], argv[2])
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
