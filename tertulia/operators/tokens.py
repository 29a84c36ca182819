"""Cleaned tokens: the text of every message as normalised words without stop words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.fixed_values import CHAT_STOP_WORDS
from tertulia.functions.base import as_text, exploded
from tertulia.functions.text import clean_text, default_stop_words, remove_accents
from tertulia.operators.ranking import top_rows


def text_column(df: DataFrame) -> str:
    """The message column if there is one, else the first column."""
    return "message" if "message" in df.columns else df.columns[0]


def stop_words(
    custom: Iterable[str] = (),
    base: Iterable[str] | None = None,
    chat_words: Iterable[str] = CHAT_STOP_WORDS,
) -> list[str]:
    """Spanish list, chat words and the caller's own words.  No call changes a later one."""
    return sorted({*(default_stop_words() if base is None else base), *chat_words, *custom})


def tokenize(
    df: DataFrame,
    text: str | None = None,
    stopwords: Sequence[str] | None = None,
    custom: Iterable[str] = (),
    fold_stopwords: bool = False,
    null_text: str | None = None,
) -> DataFrame:
    """Adds ``words``: the cleaned tokens of each message in order, stop words removed.

    Stop words are compared after accents are gone, so accented ones never match unless
    ``fold_stopwords`` folds the list as well.  The list is a literal set in the plan; for
    a list too long for that use ``filter_stopwords``.
    """
    stop = list(stop_words(custom) if stopwords is None else [*stopwords, *custom])
    if fold_stopwords:
        plain = df.sparkSession.createDataFrame([(w,) for w in stop], "w string")
        stop += [r.w for r in plain.select(remove_accents(F.col("w")).alias("w")).collect()]
    column = text or text_column(df)
    words = F.split(clean_text(as_text(F.col(column), null_text)), " ")
    drop = {"", *stop}
    return df.withColumn("words", F.filter(words, lambda w: ~w.isin(*drop)))


def explode_tokens(tokenized: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per token with its position among the kept words of its message."""
    keys = [c for c in ("chat_id", "msg_idx", "sender") if c in tokenized.columns] if keep is None else keep
    return exploded(tokenized, keys, F.col("words"), "pos", "token")


def clean_tokens(df: DataFrame, keep: Sequence[str] | None = None, **options) -> DataFrame:
    return explode_tokens(tokenize(df, **options), keep)


def filter_stopwords(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Anti-join against a stop-word table ``(token)`` of any size."""
    return tokens.join(words.select("token"), "token", "left_anti")


def clean_message_text(tokenized: DataFrame) -> DataFrame:
    """Cleaned text of each message as one string."""
    return tokenized.withColumn("clean_text", F.array_join("words", " "))


def clean_text_by_sender(
    tokenized: DataFrame, messages_per_text: int = 1000, keys: Sequence[str] = ("chat_id", "sender")
) -> DataFrame:
    """Cleaned text per sender, in message order, as one row per run of message numbers.

    A text covers at most ``messages_per_text`` message numbers: a very active sender gets
    many bounded rows, none of which is left out.
    """
    run = F.floor((F.col("msg_idx") - 1) / messages_per_text).alias("text_no")
    cleaned = tokenized.select(*keys, run, "msg_idx", F.array_join("words", " ").alias("t"))
    said = F.array_sort(F.collect_list(F.struct("msg_idx", "t")))
    text = F.array_join(F.filter(F.col("said.t"), lambda t: t != ""), " ")
    return (
        cleaned.groupBy(*keys, "text_no").agg(said.alias("said"))
        .select(*keys, "text_no", text.alias("clean_text"))
        .where(F.col("clean_text") != "")
    )


def token_counts(tokenized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, token, count).  Counts of finer groups, of this same form, are summed up instead of words."""
    if "words" not in tokenized.columns:
        if {*tokenized.columns} == {*by, "token", "count"}:
            return tokenized
        return tokenized.groupBy(*by, "token").agg(F.sum("count").alias("count"))
    words = exploded(tokenized, by, F.col("words"), "token")
    return words.groupBy(*by, "token").agg(F.count("*").alias("count"))


def top_words(tokenized: DataFrame, top_n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Most used words, overall or per group."""
    return top_rows(token_counts(tokenized, by), top_n, [F.desc("count"), F.asc("token")], by)


def top_words_per_member(tokenized: DataFrame, top_n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return top_words(tokenized, top_n, [*by, "sender"])


def is_number(word: Column) -> Column:
    # Compared first, as few words begin with a digit and the expression costs more.
    return (word >= "0") & (word < ":") & word.rlike("^[0-9]+$")
