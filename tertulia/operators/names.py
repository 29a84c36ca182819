"""Person names: candidates as rows, gazetteers of any size, Python models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tertulia.fixed_values import BLOCKED_NAME_WORDS, NAME_EXCEPTIONS
from tertulia.functions import patterns as P
from tertulia.functions import redaction as R
from tertulia.functions.base import exploded
from tertulia.functions.redaction import Detector, capitalised_names, keep_name


def name_candidates(
    messages: DataFrame, keys: Sequence[str], text: str = "message", detector: Detector = capitalised_names
) -> DataFrame:
    """One row per detected span, before any filter."""
    found = detector(R.without_titles(F.col(text)))
    return exploded(messages, keys, found, "span")


def filter_name_candidates(
    candidates: DataFrame,
    exceptions: Sequence[str] = NAME_EXCEPTIONS,
    blocked: Sequence[str] = BLOCKED_NAME_WORDS,
) -> DataFrame:
    """Candidates that are no false positives."""
    return candidates.where(keep_name(F.col("span"), exceptions, blocked))


def match_gazetteer(candidates: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Candidates with at least one word in a name table ``(name)`` of any size."""
    keys = candidates.columns
    words = candidates.withColumn(
        "word", F.explode(F.array_distinct(F.regexp_extract_all("span", F.lit(P.NON_BLANK_RUN), F.lit(0))))
    )
    known = gazetteer.select(F.col("name").alias("word"))
    return words.join(known, "word", "left_semi").select(*keys).distinct()


def redact_with_model(
    df: DataFrame,
    detector: Detector,
    text: str = "message",
    exceptions: Sequence[str] = NAME_EXCEPTIONS,
    blocked: Sequence[str] = BLOCKED_NAME_WORDS,
) -> DataFrame:
    """``redact_text`` with a detector that is a Python function.

    Such a function cannot stand inside an expression, so each step is a column of its own;
    the model sees whole Arrow batches, without empty texts and presented speakers.
    """
    staged = (
        df.withColumn("_masked", R.plain_masks(F.col(text)))
        .withColumn("_found", R.protected_spans(F.col("_masked")))
        .withColumn("_open", R.open_text(F.col("_masked"), F.col("_found")))
        .withColumn("_names", detector(F.when(~F.col("_open").rlike(P.SPEAKER), R.without_titles(F.col("_open")))))
    )
    kept = F.filter("_names", lambda span: keep_name(span, exceptions, blocked))
    whole = R.speaker_or_names(F.col("_open"), kept, F.col("_found"))
    return staged.withColumn(text, whole).select(*df.columns)
