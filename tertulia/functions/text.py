"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from tertulia.functions import patterns as P
from tertulia.functions.base import blanks_only, let, strip


def sanitize_line(line: Column) -> Column:
    """Direction marks to blanks, padding after hyphens removed, ends trimmed."""

    def tidy(text: Column) -> Column:
        padded = F.contains(text, F.lit("-"))
        return strip(F.when(padded, F.regexp_replace(text, P.HYPHEN_PADDING, "$1")).otherwise(text))

    plain = F.translate(line, P.LINE_MARKS, " " * len(P.LINE_MARKS))
    return F.when(line == "", F.lit("[Sistema]")).otherwise(let(plain, tidy))


def _accent_table() -> tuple[str, str]:
    """Letters that lose combining marks, with their bare letter (by Unicode rule)."""
    marked, bare = [], []
    for start, stop in ((0xC0, 0x530), (0x1E00, 0x2000)):
        for letter in map(chr, range(start, stop)):
            base = "".join(
                c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"
            )
            if letter != "ñ" and base != letter and len(base) == 1:
                marked.append(letter)
                bare.append(base)
    loose_marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.category(c) == "Mn"]
    # translate() deletes the characters for which it has no counterpart.
    return "".join(marked + loose_marks), "".join(bare)


_MARKED, _BARE = _accent_table()


def remove_accents(text: Column) -> Column:
    """Drop accents of Latin, Greek and Cyrillic letters; lower-case ñ is kept."""
    return F.translate(text, _MARKED, _BARE)


def strip_urls(text: Column) -> Column:
    """Delete URLs, host/path words and bare domains of the usual top-level domains."""
    return F.regexp_replace(text, P.WEB_ADDRESS, "$1")


def normalize_text(text: Column) -> Column:
    """Lower case; symbols are deleted, not replaced by blanks."""
    return F.regexp_replace(F.lower(text), P.SYMBOL, "")


def clean_text(text: Column) -> Column:
    """Underscores to blanks, web addresses out, lower case, symbols out, accents out.

    All white space comes out as blanks, so that the words are what lies between blanks.
    """
    spaced = blanks_only(text, "_")
    bare = F.regexp_replace(spaced, P.WEB_ADDRESS_BLANKS, "$1")
    plain = F.regexp_replace(F.lower(bare), P.SYMBOL_BLANKS, "")
    # Only these five accented letters are left once symbols are gone.
    return F.translate(plain, "áéíóú", "aeiou")


def default_stop_words() -> list[str]:
    """Spark's own Spanish stop words."""
    return list(StopWordsRemover.loadDefaultStopWords("spanish"))
