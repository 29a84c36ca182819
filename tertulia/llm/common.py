"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tertulia.functions.base import let
from tertulia.sources.staging import checkpointed

__all__ = ["BLANKS", "checkpointed", "documents", "in_chunks", "text_of", "window_hashes", "words_of"]

# White space of the word rule: blank and U+0009 to U+000D, nothing else.
BLANKS = r"[\x20\x09-\x0D]+"


def text_of(col: Column | str) -> Column:
    """The text, NULL counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ``BLANKS``."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def window_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of each ``width`` words in a row; fewer words give one hash of them all, none gives none."""
    def windows(h: Column) -> Column:
        last = F.greatest(F.size(h) - width, F.lit(0))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(h, i + 1, width)))
        )
    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_chunks(texts: Iterable[str | None], size: int) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters together, so that work arrays stay small."""
    chunk: list[str] = []
    held = 0
    for text in texts:
        chunk.append(text or "")
        held += len(chunk[-1])
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk
