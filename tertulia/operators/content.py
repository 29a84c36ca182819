"""Content metrics: emojis, links, adjectives, word-cloud weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.fixed_values import CLOUD_STOP_WORDS
from tertulia.functions.base import as_text, exploded
from tertulia.functions.content import extract_emojis, extract_links, url_domain
from tertulia.functions.redaction import MASKS
from tertulia.operators.ranking import top_rows
from tertulia.operators.tokens import is_number, text_column, token_counts


def emoji_frequency(
    messages: DataFrame, top_n: int | None = 10, by: Sequence[str] = (), text: str | None = None
) -> DataFrame:
    """Most used emojis; every occurrence counts."""
    column = F.col(text or text_column(messages))
    found = exploded(messages, by, extract_emojis(column), "emoji")
    counted = found.groupBy(*by, "emoji").agg(F.count("*").alias("count"))
    return top_rows(counted, top_n, [F.desc("count"), F.asc("emoji")], by)


def shared_links(messages: DataFrame, keep: Sequence[str] = (), text: str | None = None) -> DataFrame:
    """One row per link with its domain."""
    column = as_text(F.col(text or text_column(messages)))
    return exploded(messages, keep, extract_links(column), "link")


def top_shared_domains(
    messages: DataFrame,
    top_n: int | None = 10,
    by: Sequence[str] = (),
    strict: bool = False,
    text: str | None = None,
) -> DataFrame:
    """Most shared domains, always as ``(dominio, count)``."""
    domains = shared_links(messages, by, text).select(*by, url_domain(F.col("link"), strict).alias("dominio"))
    counted = domains.groupBy(*by, "dominio").agg(F.count("*").alias("count"))
    return top_rows(counted, top_n, [F.desc("count"), F.asc("dominio")], by)


def redaction_counts(redacted: DataFrame, by: Sequence[str] = ("sender",), text: str = "message") -> DataFrame:
    """Audit: masks of each kind per group, zero counts left out."""
    totals = redacted.groupBy(*by).agg(*[
        F.sum((F.length(text) - F.length(F.replace(text, F.lit(mask)))) / len(mask))
        .cast("long").alias(kind)
        for kind, mask in MASKS.items()
    ])
    return totals.unpivot(list(by), list(MASKS), "kind", "count").where(F.col("count") > 0)


def adjective_frequency(
    tokenized: DataFrame,
    lexicon: DataFrame,
    stopwords: Sequence[str] = (),
    top_n: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Adjectives by frequency, using a lexicon table ``(token, pos)``.

    Tokens are counted before they meet the lexicon, so the join sees a vocabulary and not
    the text; the lexicon is broadcast only when its size allows.
    """
    adjectives = lexicon.where(F.col("pos") == "ADJ").select(F.lower("token").alias("token")).distinct()
    if stopwords:
        adjectives = adjectives.where(~F.col("token").isin(*stopwords))
    counted = token_counts(tokenized, by).join(adjectives, "token", "left_semi")
    return _ranked_adjectives(counted, top_n, by)


def adjective_frequency_tagged(
    messages: DataFrame,
    tagger: Callable[[Column], Column],
    text: str,
    stopwords: Sequence[str] = (),
    top_n: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """As ``adjective_frequency``, with a tagger of whole messages instead of a lexicon."""
    tagged = exploded(messages, by, tagger(F.col(text)), "tag")
    adjectives = tagged.where(F.col("tag.pos") == "ADJ").select(*by, F.lower("tag.token").alias("token"))
    if stopwords:
        adjectives = adjectives.where(~F.col("token").isin(*stopwords))
    counted = adjectives.groupBy(*by, "token").agg(F.count("*").alias("count"))
    return _ranked_adjectives(counted, top_n, by)


def _ranked_adjectives(counted: DataFrame, top_n: int | None, by: Sequence[str]) -> DataFrame:
    ranked = top_rows(counted, top_n, [F.desc("count"), F.asc("token")], by)
    return ranked.select(*by, F.col("token").alias("adjetivo"), "count")


# --- word cloud -----------------------------------------------------------------------


def _cloud_words(tokenized: DataFrame, min_length: int, by: Sequence[str] = ()) -> DataFrame:
    """Words a cloud looks at: numbers and shorter words never take part in a pair."""
    return tokenized.select(
        *by, F.filter("words", lambda w: (F.length(w) >= min_length) & ~is_number(w)).alias("words")
    )


def _singular(word: Column) -> Column:
    plural = word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def _merge_plurals(counted: DataFrame, *others: str) -> DataFrame:
    """Adds a plural's count to its singular where both occur, by one grouping, no join."""
    merged = (
        counted.groupBy(*others, _singular(F.col("word")).alias("stem"))
        .agg(
            F.sum("n").alias("n"),
            F.bool_or(F.col("word") == _singular(F.col("word"))).alias("has_singular"),
        )
    )
    word = F.when(F.col("has_singular"), F.col("stem")).otherwise(F.concat("stem", F.lit("s")))
    return merged.select(*others, word.alias("word"), "stem", "n")


def word_and_pair_counts(
    tokenized: DataFrame, min_length: int = 1, stopwords: Sequence[str] = CLOUD_STOP_WORDS, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of words by the word that follows in the message: ``(*by, word, next_word, n)``.

    ``next_word`` is NULL at the end of a message and before a stop word.  Each word looks up
    the next one by its position, so no window is needed; single words and pairs both
    come from this one pass and shuffle.  What follows joins the table with itself several
    times: stage it first (``Staged``), or the text is read as often.
    """
    words = _cloud_words(tokenized, min_length, by)
    seen = exploded(words, [*by, "words"], F.col("words"), "__at", "word").select(
        *by, "word", F.get("words", F.col("__at") + 1).alias("next_word"))
    follows = F.when(~F.col("next_word").isin(*stopwords), F.col("next_word"))
    return (
        seen.where(~F.col("word").isin(*stopwords))
        .groupBy(*by, "word", follows.alias("next_word"))
        .agg(F.count("*").alias("n"))
    )


def unigrams(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, word, stem, n): the vocabulary of ``word_and_pair_counts``, plurals with their singular."""
    return _merge_plurals(counts.groupBy(*by, "word").agg(F.sum("n").alias("n")), *by)


_vocabulary = unigrams


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    floor = F.lit(1e-10)
    return F.log(F.greatest(p, floor)) * k + F.log(F.greatest(1 - p, floor)) * (n - k)


def collocation_score(pair: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio that the second word depends on the first."""
    free, tied = second / total, pair / first
    elsewhere = (second - pair) / (total - first)
    ratio = (
        _log_likelihood(pair, first, free)
        + _log_likelihood(second - pair, total - first, free)
        - _log_likelihood(pair, first, tied)
        - _log_likelihood(second - pair, total - first, elsewhere)
    )
    return F.when((total <= first) | (total <= second), F.lit(0.0)).otherwise(-2 * ratio)


# Scores of larger totals may differ from the ratio by the floor under its logarithms.
_EXACT_TOTAL = 1e9


def _entropy(x: Column) -> Column:
    return x * F.log(F.greatest(x, F.lit(1.0)))


def _often(first: Column, most: Column, total: Column, min_score: float) -> Column:
    """Whether pairs of a first word can score above ``min_score`` by being rarer than chance: no second word has more than ``most``.

    The ratio is largest where the two words never meet and is then at most ``-2 most log(1 - first / (total - most))``.
    """
    rest = total - most
    return F.when((total < _EXACT_TOTAL) & (first < rest), -2 * most * F.log(1 - first / rest) > min_score - 1).otherwise(True)


def _may_pass(min_score: float) -> Column:
    """Whether a pair can score above ``min_score``, before the count of its second word is known.

    For given counts of the pair, the first word and all words the ratio first falls and then rises with the count of the
    second word.  It is largest at an end: ``often`` says of a very frequent one, and at the pair's own count, the least
    there is, the ratio is below the expression here.  The margin is far above rounding.  A word that follows itself is kept.
    """
    pair, first = F.col("n").cast("double"), F.col("n_first").cast("double")
    together = 2 * (pair * (F.log("total") + 1) - _entropy(first) + _entropy(first - pair))
    return F.col("often") | (F.col("first_stem") == F.col("second_stem")) | (together > min_score - 1)


def _scored_pairs(counts: DataFrame, single: DataFrame, by: Sequence[str] = (), min_score: float | None = None) -> DataFrame:
    """Pairs with the counts of both words (plural forms counted with their singular).

    With ``min_score`` pairs that cannot score above it are left out as soon as their first word's count is known: most
    pairs occur once, and only the others move on to their second word.  The pairs move once, by their first word, for both
    the merging of plurals and that count; words lead the keys, as sorting compares the start of the first key.
    """
    # A struct holds a NULL group like any other, so that plain equality finds it.
    key = ["__group"] if by else []
    group = [F.struct(*by).alias("__group")] if by else []
    first = single.select(*group, F.col("stem").alias("first_stem"), F.col("word").alias("first_form"), F.col("n").alias("n_first"))
    second = single.select(*group, F.col("stem").alias("second_stem"), F.col("word").alias("second_form"), F.col("n").alias("n_second"))
    sums = [F.sum("n").cast("double").alias("total"), F.max("n").cast("double").alias("most")]
    if by:
        first = first.join(single.groupBy(*group).agg(*sums), key)
    else:
        one = single.select(F.struct(*sums)).scalar()
        first = first.withColumns({"total": one["total"], "most": one["most"]})
    if min_score is not None:
        often = _often(F.col("n_first").cast("double"), F.col("most"), F.col("total"), min_score)
        first = first.withColumn("often", often)
    first = first.drop("most")
    following = (
        counts.where(F.col("next_word").isNotNull())
        .select(*group, F.col("word").alias("first_word"), _singular(F.col("word")).alias("first_stem"), F.col("next_word").alias("word"), "n")
        .repartition("first_stem", *key)
    )
    pairs = _merge_plurals(following, *key, "first_stem", "first_word").withColumnRenamed("stem", "second_stem")
    joined = pairs.join(first, ["first_stem", *key])
    if min_score is not None:
        joined = joined.where(_may_pass(min_score))
    joined = joined.join(second, ["second_stem", *key])
    double = lambda c: F.col(c).cast("double")
    return joined.select(
        *[F.col(f"__group.{c}").alias(c) for c in by], F.concat_ws(" ", "first_word", "word").alias("bigram"),
        "first_form", "second_form", "n", "n_first", "n_second",
        collocation_score(double("n"), double("n_first"), double("n_second"), F.col("total")).alias("score"),
    )


def collocated_pairs(counts: DataFrame, unigrams: DataFrame, by: Sequence[str] = (), min_score: float = 30.0) -> DataFrame:
    """Pairs above the score with the words they are made of: what both results below start from, to be staged once for the two."""
    return _scored_pairs(counts, unigrams, by, min_score).where(F.col("score") > min_score)


def bigram_collocations(
    counts: DataFrame, top_n: int | None = None, min_score: float = 30.0, unigrams: DataFrame | None = None,
    by: Sequence[str] = (), pairs: DataFrame | None = None,
) -> DataFrame:
    """Neighbouring word pairs that occur together more often than chance explains.

    ``counts`` comes from ``word_and_pair_counts``, ``unigrams`` from ``unigrams(counts)``, staged when several results share it;
    both with the same ``by``.  ``pairs`` is ``collocated_pairs`` of them with a ``min_score`` no higher.
    """
    if pairs is None:
        pairs = _scored_pairs(counts, _vocabulary(counts, by) if unigrams is None else unigrams, by, min_score)
    kept = pairs.where(F.col("score") > min_score).select(*by, "bigram", F.col("n").alias("count"), "score")
    return top_rows(kept, top_n, [F.desc("score"), F.asc("bigram")], by)


def term_weights(
    counts: DataFrame, max_terms: int = 200, min_score: float = 30.0, unigrams: DataFrame | None = None,
    by: Sequence[str] = (), pairs: DataFrame | None = None,
) -> DataFrame:
    """Word-cloud weights: words and collocations by count, relative to the largest; ``max_terms`` per group.

    A collocation's count is taken off both of its words.  ``pairs`` as in ``bigram_collocations``.
    """
    single = _vocabulary(counts, by) if unigrams is None else unigrams
    collocations = (_scored_pairs(counts, single, by, min_score) if pairs is None else pairs).where(F.col("score") > min_score)
    changes = F.array(
        F.struct(F.col("bigram").alias("term"), F.col("n").alias("n")),
        F.struct(F.col("first_form").alias("term"), (-F.col("n")).alias("n")),
        F.struct(F.col("second_form").alias("term"), (-F.col("n")).alias("n")),
    )
    counts = (
        single.select(*by, F.col("word").alias("term"), "n")
        .unionByName(collocations.select(*by, F.inline(changes)))
        .groupBy(*by, "term")
        .agg(F.sum("n").alias("count"))
        .where(F.col("count") > 0)
    )
    top = top_rows(counts, max_terms, [F.desc("count"), F.asc("term")], by)
    # At most max_terms rows of each group reach this window.
    largest = F.max("count").over(Window.partitionBy(*by or [F.lit(0)]))
    return top.select(*by, "term", "count", (F.col("count") / largest).alias("weight"))
