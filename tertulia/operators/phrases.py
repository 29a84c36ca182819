"""The false-positive filter of names against phrase and word tables of any size.

The expression form (``keep_name``) tests every phrase for every span.  Here the two containments, a phrase inside a span
and a span inside a phrase, are equality joins: every string is indexed by its runs of ``GRAM`` characters, the one
looked for brings only its rarest run, and what meets is verified.  Both sides are distinct strings, so the text's size
does not matter, and a run that many strings share is used only where a string has no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions import patterns as P

GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct runs of ``GRAM`` characters; none of a shorter text."""
    spots = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(GRAM))))


def _short_parts(text: Column) -> Column:
    """Distinct substrings shorter than ``GRAM``, the empty one included."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in range(1, GRAM)]))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of distinct strings, both in a column ``s``: every pair where the first stands inside the second."""
    index = outer.select(F.col("s").alias("outer"), F.explode(_grams(F.col("s"))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    keys = inner.select(F.col("s").alias("inner"), F.explode(_grams(F.col("s"))).alias("gram")).join(often, "gram", "left")
    rarest = keys.groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k"))
    # A run that no outer string has rules its string out.
    rarest = rarest.where(F.col("k.n") > 0).select("inner", F.col("k.gram").alias("gram"))
    long = rarest.join(index, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")
    short = inner.where(F.length("s") < GRAM).select(F.col("s").alias("inner"))
    parts = outer.select(F.col("s").alias("outer"), F.explode(_short_parts(F.col("s"))).alias("inner"))
    return long.unionByName(short.join(parts, "inner").select("inner", "outer"))


def exempt_spans(spans: DataFrame, phrases: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Distinct values of ``span`` that are no names: ``phrases`` (phrase) by containment either way, case aside,
    ``blocked`` (word) by any word of the span or the whole span; spans of one word are none either.  NULLs in the
    tables mean nothing."""
    distinct = spans.select("span").where(F.col("span").isNotNull()).distinct()
    words = distinct.withColumn("words", F.regexp_extract_all("span", F.lit(P.NON_BLANK_RUN), F.lit(0)))
    single = words.where(F.size("words") < 2).select("span")
    lowered = distinct.select(F.lower("span").alias("s")).distinct()
    listed = phrases.select(F.lower("phrase").alias("s")).where(F.col("s").isNotNull()).distinct()
    hit = contained(listed, lowered).select(F.col("outer").alias("s")).unionByName(contained(lowered, listed).select(F.col("inner").alias("s")))
    out = single.unionByName(distinct.withColumn("s", F.lower("span")).join(hit, "s", "left_semi").select("span"))
    if blocked is not None:
        named = blocked.select(F.col("word")).where(F.col("word").isNotNull()).distinct()
        parts = words.select("span", F.explode(F.array_union("words", F.array("span"))).alias("word"))
        out = out.unionByName(parts.join(named, "word", "left_semi").select("span"))
    return out.distinct()


def filter_candidates_by_table(candidates: DataFrame, phrases: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Candidates (with a column ``span``) that are no false positives; the same rows as ``filter_name_candidates`` with lists."""
    named = candidates.where(F.col("span").isNotNull())
    return named.join(exempt_spans(candidates, phrases, blocked), "span", "left_anti").select(*candidates.columns)
