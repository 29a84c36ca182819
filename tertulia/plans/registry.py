"""Registered queries: each operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.functions.base import exploded
from tertulia.functions import content as C, redaction as R, temporal as W, text as T
from tertulia.operators import content, ingest, members, names, temporal, tokens
from tertulia.plans import fixtures as fx, learned, round_trips
from tertulia.schema import LEXICON
from tertulia.sources import writers
from tertulia.sources.readers import read_chat_lines, read_messages_csv
from tertulia.sources.staging import Staged, checkpointed

Query = Callable[[SparkSession, str], DataFrame]

# The driver's prose is invented; these words occur in it once cleaned.
FIXTURE_LEXICON = [
    ("orre", "ADJ"), ("thble", "ADJ"), ("cionado", "ADJ"), ("osado", "ADJ"), ("libre", "ADJ"),
    ("thatin", "ADJ"), ("erble", "ADJ"), ("the", "DET"), ("ononst", "NOUN"), ("cionmente", "ADV"),
]
PARTIAL_STOP_TABLE = [("the",), ("of",), ("and",), ("que",), ("hola",), ("mira",)]


def _plain(step) -> Query:
    return lambda spark, d: fx.v_messages(spark, d).select("msg_id", step(F.col("message")).alias("message"))


def _masked(step) -> Query:
    return lambda spark, d: fx.v_decorated(spark, d).select("msg_id", step(F.col("message")).alias("message"))


def _on_messages(operator, **options) -> Query:
    return lambda spark, d: operator(fx.v_messages(spark, d), **options)


def _on_events(operator, **options) -> Query:
    return lambda spark, d: operator(fx.v_events_messages(spark, d), **options)


def _on_words(operator, view=fx.v_messages, **options) -> Query:
    return lambda spark, d: operator(tokens.tokenize(view(spark, d)), **options)


def _on_counts(operator, by=()) -> Query:
    """The counts and the vocabulary are staged as Parquet, a fraction of a checkpoint's bytes; the result alone is checkpointed."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = tokens.tokenize(fx.v_messages(spark, sf_dir))
        with Staged(content.word_and_pair_counts(words, by=by), "counts") as counts, Staged(content.unigrams(counts, by), "unigrams") as single:
            return checkpointed(operator(counts, unigrams=single, by=by))
    return run


def _events_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.date_format("ts", "dd/MM/yyyy, HH:mm").alias("timestamp")
    )


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parse_chat_lines(fx.v_lines(spark, d))


def chat_line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Writes the export lines as text files and scans them with the chat reader."""
    with _exported(spark, d) as lines:
        return checkpointed(lines.groupBy("chat_id").agg(
            F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars")
        ))


@contextmanager
def _exported(spark: SparkSession, d: str):
    """Lines that went through text files and ``read_chat_lines``; the files, real text, go at the end."""
    with round_trips.folder(spark, "export") as path:
        round_trips.write_export(spark, d, path)
        yield read_chat_lines(spark, path, F.col("chat_id"), F.col("_metadata.file_name"))


def export_scan_anonymize(spark: SparkSession, d: str) -> DataFrame:
    """Export lines as text files, read back in splits and anonymised: the order must survive."""
    with _exported(spark, d) as lines:
        return checkpointed(ingest.anonymize(lines))


def preamble_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines before the first message, where chats of even number have only headerless lines at their start."""
    lines = fx.v_lines(spark, d)
    bare = F.when(F.pmod(F.col("seq"), F.lit(7 * fx.SEQ_WIDTH)) < 5 * fx.SEQ_WIDTH, F.concat(F.lit("> "), "value")).otherwise(F.col("value"))
    kept = lines.withColumn("value", F.when(F.col("chat_id").rlike("[02468]$"), bare).otherwise(F.col("value")))
    return ingest.preamble_lines(ingest.parse_chat_lines(kept)).select("chat_id", "seq", "text")


def features_csv(spark: SparkSession, d: str) -> DataFrame:
    """User statistics of a message table that went through CSV files."""
    with round_trips.folder(spark, "csv") as path:
        writers.write_csv(fx.v_messages(spark, d).select("timestamp", "sender", "message"), path)
        return checkpointed(members.user_statistics(read_messages_csv(spark, path), null_text="nan"))


def redact_null_text(spark: SparkSession, d: str) -> DataFrame:
    """Missing texts masked as the text ``nan``."""
    missing = F.when(F.col("msg_id") % 3 > 0, F.col("message"))
    return fx.v_decorated(spark, d).select("msg_id", R.redact_text(missing, null_text="nan").alias("message"))


def conversation_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the roles of each conversation."""
    talks = spark.read.parquet(f"{d}/conversations.parquet")
    messages = talks.select("conv_id", F.col("role").alias("sender"), F.col("text").alias("message"))
    return members.user_statistics(messages, by=["conv_id"], ordered=False)


# Forms of a written moment and the unit each keeps.
MIXED_FORMS = (
    ("MM/dd/yyyy", "day"), ("MM/dd/yy", "day"), ("MM-dd-yyyy HH:mm", "minute"), ("MM.dd.yyyy HH:mm", "minute"),
    ("yyyy/MM/dd HH:mm:ss", "second"), ("MMM d yyyy HH:mm", "minute"), ("d MMMM yyyy, h:mm a", "minute"),
    ("yyyy-MM-dd'T'HH:mm:ss", "second"),
)


def parse_mixed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Event times written in eight forms, one after another, and read again."""
    forms = F.array(*[F.date_format("ts", form) for form, _ in MIXED_FORMS])
    text = F.get(forms, (F.col("event_id") % len(MIXED_FORMS)).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", W.parse_chat_timestamp(text).alias("moment"))


def parse_chat_lines(spark: SparkSession, d: str) -> DataFrame:
    found = [F.coalesce(c, F.lit("")).alias(c) for c in ("timestamp", "sender")]
    return _parsed(spark, d).select("chat_id", "seq", "is_header", *found, "text")


def render_anonymized(spark: SparkSession, d: str) -> DataFrame:
    messages = ingest.assemble_messages(_parsed(spark, d))
    return ingest.render_anonymized(ingest.pseudonymize_senders(messages))


def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    return names.filter_name_candidates(names.name_candidates(fx.v_decorated(spark, d), ["msg_id"]))


def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    masked = fx.v_decorated(spark, d).select("sender", R.redact_text(F.col("message")).alias("message"))
    return content.redaction_counts(masked)


def filter_stopwords(spark: SparkSession, d: str) -> DataFrame:
    words = tokens.tokenize(fx.v_decorated(spark, d), stopwords=[])
    table = spark.createDataFrame(PARTIAL_STOP_TABLE, "token string")
    return tokens.filter_stopwords(tokens.token_counts(words), table)


def clean_text_by_sender(spark: SparkSession, d: str) -> DataFrame:
    messages = fx.v_messages(spark, d).withColumn("msg_idx", F.col("msg_id") + 1)
    return tokens.clean_text_by_sender(tokens.tokenize(messages), 250)


def adjective_frequency(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame(FIXTURE_LEXICON, LEXICON)
    return content.adjective_frequency(tokens.tokenize(fx.v_decorated(spark, d)), lexicon)


def activity_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks without NULLs: no day as an empty text, no hour as -1."""
    return temporal.activity_peaks(fx.v_events_messages(spark, d)).na.fill({"day_name": "", "hour": -1})


def _found(extract, name: str) -> Query:
    return lambda spark, d: exploded(
        fx.v_decorated(spark, d), ["msg_id"], extract(F.col("message")), "pos", name
    )


def _url_domain(strict: bool) -> Query:
    return lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select(
        "page_id", C.url_domain(F.col("url"), strict).alias("dominio")
    )


def _marked(text):
    return F.replace(text, F.lit(". "), F.lit(".\u200f "))


QUERIES: dict[str, Query] = {
    "chat_line_scan": chat_line_scan,
    "export_scan_anonymize": export_scan_anonymize,
    "preamble_lines": preamble_lines,
    "features_csv": features_csv,
    "redact_null_text": redact_null_text,
    "conversation_statistics": conversation_statistics,
    "parse_mixed_timestamps": parse_mixed_timestamps,
    "top_active_members_by_chat": _on_messages(members.top_active_members, by=["chat_id"]),
    "participation_profile_by_chat": _on_messages(members.participation_profile, by=["chat_id"]),
    "messages_of_top_members_by_chat": lambda s, d: members.messages_of_top_members(
        fx.v_messages(s, d), 3, ["chat_id"]).select("msg_id", "chat_id", "sender", "message"),
    "sanitize_lines": lambda s, d: ingest.sanitize_lines(fx.v_lines(s, d)).select("chat_id", "seq", "clean"),
    "parse_chat_lines": parse_chat_lines,
    "assemble_messages": lambda s, d: ingest.assemble_messages(_parsed(s, d)),
    "pseudonymize_senders": lambda s, d: ingest.pseudonymize_senders(ingest.assemble_messages(_parsed(s, d))),
    "render_anonymized": render_anonymized,
    "anonymize_chat": lambda s, d: ingest.anonymize(fx.v_lines(s, d)),
    "redact_marks": _plain(lambda text: R.redact_marks(_marked(text))),
    "redact_brackets": _masked(R.redact_brackets),
    "redact_phones": _masked(R.redact_phones),
    "redact_emails": _masked(R.redact_emails),
    "redact_tilde_names": _masked(R.redact_tilde_names),
    "redact_speaker_lines": _masked(R.redact_speaker_lines),
    "redact_person_names": _masked(R.redact_person_names),
    "filter_name_candidates": name_candidates,
    "redact_text": _masked(R.redact_text),
    "redaction_counts": redaction_counts,
    "remove_accents": _plain(T.remove_accents),
    "strip_urls": _masked(T.strip_urls),
    "normalize_text": _masked(T.normalize_text),
    "filter_stopwords": filter_stopwords,
    "clean_tokens": lambda s, d: tokens.clean_tokens(fx.v_decorated(s, d), ["msg_id"]),
    "clean_text_by_sender": clean_text_by_sender,
    "exclude_system": lambda s, d: members.exclude_system(fx.v_messages(s, d)).select("msg_id", "sender", "message"),
    "message_word_count": lambda s, d: members.with_word_count(fx.v_messages(s, d)).select("msg_id", "word_count"),
    "message_size": lambda s, d: members.with_message_size(fx.v_messages(s, d)).select("msg_id", "message_size"),
    "top_active_members": _on_messages(members.top_active_members),
    "avg_user_word_count": _on_messages(members.avg_user_word_count),
    "user_statistics": _on_messages(members.user_statistics),
    "users_short_messages": _on_messages(members.users_short_messages),
    "message_size_boxplot": _on_messages(members.message_size_boxplot),
    "messages_of_top_members": lambda s, d: members.messages_of_top_members(
        fx.v_messages(s, d)).select("msg_id", "sender", "message"),
    "participation_profile": _on_messages(members.participation_profile),
    "parse_chat_timestamp": lambda s, d: _events_with_id(s, d).select(
        "event_id", W.parse_chat_timestamp(F.col("timestamp")).alias("moment")),
    "message_hour": lambda s, d: temporal.with_calendar(_events_with_id(s, d)).select("event_id", "hour"),
    "message_weekday": lambda s, d: temporal.with_calendar(_events_with_id(s, d)).select("event_id", "day_idx", "day_name"),
    "messages_by_day": _on_events(temporal.messages_by_day),
    "messages_by_hour": _on_events(temporal.messages_by_hour),
    "messages_by_hour_dense": _on_events(temporal.messages_by_hour, dense=True),
    "activity_heatmap": _on_events(temporal.activity_heatmap),
    "activity_peaks": activity_peaks,
    "date_range": _on_events(temporal.date_range),
    "adjective_frequency": adjective_frequency,
    "extract_emojis": _found(C.extract_emojis, "emoji"),
    "emoji_frequency": lambda s, d: content.emoji_frequency(fx.v_decorated(s, d)),
    "extract_links": _found(C.extract_links, "link"),
    "url_domain": _url_domain(False),
    "url_domain_strict": _url_domain(True),
    "top_shared_domains": lambda s, d: content.top_shared_domains(fx.v_decorated(s, d)),
    "term_weights": _on_counts(content.term_weights),
    "term_weights_by_chat": _on_counts(content.term_weights, by=["chat_id"]),
    "bigram_collocations": lambda s, d: _on_counts(content.bigram_collocations)(s, d).withColumn(
        "score", F.round("score", 4)),
    "top_words": _on_words(tokens.top_words),
    "top_words_per_member": _on_words(tokens.top_words_per_member),
    **round_trips.QUERIES,
    **learned.QUERIES,
}
