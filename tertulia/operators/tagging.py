"""Part of speech of words that no lexicon lists, by a suffix trie learned from one.

A node is an ending of up to ``longest`` letters; it holds the part of speech that most lexicon words with it have.  An
unknown word takes the part of speech of the longest ending the trie knows (back-off to shorter ones).  Words are
counted before they meet the trie, so its joins see a vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.operators.ranking import top_rows
from tertulia.operators.tokens import token_counts


def _endings(word: Column, longest: int) -> Column:
    """The word's endings of 1 to ``longest`` letters."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(word), F.lit(longest))), lambda n: F.substring(word, F.length(word) - n + 1, n))


def learn_endings(lexicon: DataFrame, longest: int = 5, least: int = 2) -> DataFrame:
    """(ending, pos, n, share): the commonest part of speech of each ending that ``least`` lexicon words have.

    Words count once per part of speech; ties go to the part of speech that comes first.
    """
    words = lexicon.select(F.lower("token").alias("token"), "pos").where((F.length("token") > 0) & F.col("pos").isNotNull()).distinct()
    counted = words.select("pos", F.explode(_endings(F.col("token"), longest)).alias("ending")).groupBy("ending", "pos").agg(F.count("*").alias("n"))
    best = counted.groupBy("ending").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), "pos")).alias("b"))
    return best.where(F.col("total") >= least).select(
        "ending", "b.pos", (-F.col("b.less")).alias("n"), (-F.col("b.less") / F.col("total")).alias("share"))


def guess_pos(words: DataFrame, endings: DataFrame, longest: int = 5, token: str = "token") -> DataFrame:
    """(token, pos) of distinct words; a word without any known ending is left out."""
    each = words.select(F.col(token).alias("token")).where(F.length("token") > 0).distinct()
    met = each.select("token", F.explode(_endings(F.lower("token"), longest)).alias("ending")).join(endings, "ending")
    return met.groupBy("token").agg(F.max_by("pos", F.length("ending")).alias("pos"))


def adjectives_with_guesses(
    tokenized: DataFrame, lexicon: DataFrame, longest: int = 5, least: int = 2, top_n: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``adjective_frequency`` with words the lexicon lacks tagged by their endings: adjetivo, count, guessed."""
    counts = token_counts(tokenized, by)
    known = lexicon.select(F.lower("token").alias("token"), "pos").where(F.col("token").isNotNull())
    listed = known.groupBy("token").agg(F.max((F.col("pos") == "ADJ").cast("int")).alias("listed"))
    vocabulary = counts.select("token").distinct().join(listed, "token", "left")
    guessed = guess_pos(vocabulary.where(F.col("listed").isNull()), learn_endings(lexicon, longest, least), longest)
    adjectives = vocabulary.where(F.col("listed") == 1).select("token", F.lit(False).alias("guessed")).unionByName(
        guessed.where(F.col("pos") == "ADJ").select("token", F.lit(True).alias("guessed")))
    found = counts.join(adjectives, "token").select(*by, F.col("token").alias("adjetivo"), "count", "guessed")
    return top_rows(found, top_n, [F.desc("count"), F.asc("adjetivo")], by)
