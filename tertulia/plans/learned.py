"""Registered queries of what is learned from tables: names, parts of speech, phrase lists, date order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.fixed_values import BLOCKED_NAME_WORDS, NAME_EXCEPTIONS
from tertulia.functions.base import exploded
from tertulia.functions.name_model import count_names, hmm_names, train_names
from tertulia.functions import redaction as R
from tertulia.operators import date_order, leaks, names, phrases, tagging, tokens
from tertulia.plans import fixtures as fx
from tertulia.schema import LEXICON

# The names that the decorated fixture holds, by msg_id % 13.
PLANTED = {
    3: ["Juan Perez"], 4: ["Ana Maria"], 5: ["Maria Perez"], 6: ["Juan Perez", "Maria Lopez"], 10: ["Juan Lasso"],
    11: ["Ana Losada Lastra"], 12: ["Eva de la Cruz"],
}
# Beside the exceptions: a phrase inside spans, one around a span, a short one.
MORE_PHRASES = ["maria perez", "saludos a juan lasso y todos", "zq"]
ENDINGS_LEXICON = [
    ("orre", "ADJ"), ("thble", "ADJ"), ("erble", "ADJ"), ("cionado", "ADJ"), ("osado", "ADJ"), ("the", "DET"), ("ononst", "NOUN"),
    ("cionmente", "ADV"), ("thtion", "NOUN"), ("ntion", "NOUN"), ("eution", "NOUN"), ("libre", "ADJ"),
]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Every decorated message with the names planted in it."""
    listed = F.lit(None).cast("array<string>")
    for rest, held in PLANTED.items():
        listed = F.when(F.col("msg_id") % len(fx.DECORATIONS) == rest, F.array(*[F.lit(n) for n in held])).otherwise(listed)
    return fx.v_decorated(spark, d).select("msg_id", F.col("message").alias("text"), listed.alias("names"))


def name_model_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_names(_labelled(spark, d))


def hmm_name_spans(spark: SparkSession, d: str) -> DataFrame:
    """Names the trained model finds in every message."""
    labelled = _labelled(spark, d)
    return exploded(labelled, ["msg_id"], hmm_names(train_names(labelled))(F.col("text")), "pos", "name")


def candidates_by_phrase_table(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([(p,) for p in [*NAME_EXCEPTIONS, *MORE_PHRASES]], "phrase string")
    blocked = spark.createDataFrame([(w,) for w in BLOCKED_NAME_WORDS], "word string")
    return phrases.filter_candidates_by_table(names.name_candidates(fx.v_decorated(spark, d), ["msg_id"]), listed, blocked)


def adjective_guessed(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame(ENDINGS_LEXICON, LEXICON)
    return tagging.adjectives_with_guesses(tokens.tokenize(fx.v_decorated(spark, d)), lexicon, longest=4)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Messages in order of their moment; chats of odd number write the month first."""
    form = F.when(F.col("chat_id").rlike("[13579]$"), F.date_format("ts", "MM/dd/yy, HH:mm")).otherwise(F.date_format("ts", "dd/MM/yy, HH:mm"))
    return fx.v_messages(spark, d).select("msg_id", "chat_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("msg_idx"), form.alias("timestamp"))


def date_order_by_chat(spark: SparkSession, d: str) -> DataFrame:
    return date_order.infer_date_order(_dated(spark, d))


def inferred_moments(spark: SparkSession, d: str) -> DataFrame:
    return date_order.with_inferred_moment(_dated(spark, d)).select("msg_id", "moment")


MISSPELT = ["Mirra Libres", "Tena Lassa", "Al Holaa"]


def left_names(spark: SparkSession, d: str) -> DataFrame:
    """Words of the masked messages that nearly are a word of made-up members' names, the same in every chat."""
    masked = fx.v_decorated(spark, d).select("chat_id", R.redact_text(F.col("message")).alias("message"))
    chats = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("chat_id")).distinct()
    return leaks.left_names(masked, chats.withColumn("sender", F.explode(F.array(*[F.lit(n) for n in MISSPELT]))))


QUERIES = {
    "name_model_counts": name_model_counts,
    "hmm_name_spans": hmm_name_spans,
    "candidates_by_phrase_table": candidates_by_phrase_table,
    "adjective_guessed": adjective_guessed,
    "date_order_by_chat": date_order_by_chat,
    "inferred_moments": inferred_moments,
    "left_names": left_names,
}
