"""What masking left: words of masked messages that nearly are a word of a member's name.

Two words at most one edit apart (a letter more, less or other) share a word with at most one letter deleted, so the fuzzy
comparison is an equality join on deletion neighbourhoods, verified by the edit distance.  Messages are counted into a vocabulary
per chat first, names are distinct words, so neither the text's size nor a frequent word multiplies anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_LETTERS = 4


def _words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) >= MIN_LETTERS)


def _neighbourhood(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    without = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def left_names(masked: DataFrame, names: DataFrame, text: str = "message") -> DataFrame:
    """(chat_id, sender, name_word, word, distance, count): words of a chat's messages within one edit of a word of a
    sender's name, and how often they stand there.

    ``names`` has chat_id and sender.  Words of fewer than ``MIN_LETTERS`` letters are not compared; case is ignored; NULL
    texts and senders have no words; NULL chats are a chat.
    """
    chat = F.coalesce(F.concat(F.lit("c"), F.col("chat_id").cast("string")), F.lit("")).alias("chat")
    counted = masked.select(chat, F.explode(_words(F.col(text))).alias("word")).groupBy("chat", "word").agg(F.count("*").alias("count"))
    listed = names.select(chat, "chat_id", "sender", F.explode(F.array_distinct(_words(F.col("sender")))).alias("name_word")).distinct()
    # Names are few: their neighbourhoods decide which words of the vocabulary go on.
    wanted = listed.select("chat", "name_word").distinct().select("chat", "name_word", F.explode(_neighbourhood(F.col("name_word"))).alias("near"))
    held = counted.select("chat", "word", F.explode(_neighbourhood(F.col("word"))).alias("near"))
    pairs = held.join(wanted, ["chat", "near"]).select("chat", "word", "name_word").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("word", "name_word")).where(F.col("distance") <= 1)
    return pairs.join(counted, ["chat", "word"]).join(listed, ["chat", "name_word"]).select(
        "chat_id", "sender", "name_word", "word", "distance", "count")
