"""Quality rules, lines first: drop lines that fail, then documents that lose too much.

Each line of a text is held against three rules.

* punctuation: at least ``min_marks`` characters that are neither letter, digit nor white space, and
  more than ``max_marks_percent`` of the line's visible characters;
* navigation: at least ``min_separators`` menu separators, with few words between them;
* boilerplate: a short line with one of ``phrases``, as whole words, case aside.

Failing lines are removed.  A document is rejected when the removed lines held more than
``max_loss_percent`` of its word characters, or when it fails the base rules (too few words, or too
many words in repeated windows).  Everything is a column expression over one row: no shuffle, no
Python, linear or n log n in the length of a text.

Defined results: NULL text counts as empty; empty texts have no word and are rejected by the base
rules; repeated rows and equal texts are judged alike, one row each; an empty table gives an empty
table; input columns named like a result are replaced by it, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.base import let
from tertulia.llm.common import BLANKS, text_of, window_hashes, words_of

SYMBOLS = "#*$%&|<>"
# In lower case, by language: English, Spanish, French, German.
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "enable javascript", "lorem ipsum", "click here", "read more", "sign up", "log in", "powered by", "subscribe to",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aceptar cookies", "haz clic aquí", "leer más",
    "iniciar sesión", "aviso legal",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies", "cliquez ici", "lire la suite", "mentions légales",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "weiterlesen",
)


def boilerplate_pattern(phrases: Sequence[str]) -> str:
    """Any of the phrases as whole words; the same in Java's, DuckDB's and Python's expressions."""
    plain = "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", p) for p in phrases)
    return f"(?:^|[^a-zà-öø-ÿ0-9_])(?:{plain})(?:$|[^a-zà-öø-ÿ0-9_])"


BOILERPLATE = boilerplate_pattern(PHRASES)
NOT_MARKS = r"[\p{L}\p{M}\p{N}\s]+"
SEPARATORS = r"[|»›·•]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_marks: int = 4
    max_marks_percent: int = 12
    min_separators: int = 2
    words_per_separator: int = 4
    boilerplate_words: int = 25
    phrases: tuple[str, ...] = PHRASES
    max_loss_percent: int = 30


def _covered(win: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more, each word once."""
    def runs(pairs: Column) -> Column:
        same = lambda e, k: F.coalesce(
            (e["h"] == F.get(pairs, k - 1)["h"]) | (k < 0), F.lit(False)
        ) | F.coalesce(e["h"] == F.get(pairs, k + 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, same), lambda e: e["i"]))

    def total(at: Column) -> Column:
        step = lambda v, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - v, F.lit(width)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, x: a + x)

    sorted_pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(sorted_pairs, runs), total)


def repeat_words(words: Column, width: int = 8) -> Column:
    """Number of words inside windows of ``width`` words that the text has at least twice."""
    def count(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(_covered(win, width))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(window_hashes(words, width), count)).cast("long")


def visible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANKS, "")).cast("long")


def line_fails(line: Column, rules: Rules) -> Column:
    """True where a line breaks the punctuation, navigation or boilerplate rule."""
    marks = F.length(F.regexp_replace(line, NOT_MARKS, ""))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    n_words = F.size(words_of(line))
    punctuation = (marks >= rules.min_marks) & (marks * 100 > visible(line) * rules.max_marks_percent)
    navigation = (separators >= rules.min_separators) & (n_words <= separators * (rules.words_per_separator + 1))
    boilerplate = F.lit(False)
    if rules.phrases:
        # The cheap test first: only short lines are searched.
        boilerplate = (n_words <= rules.boilerplate_words) & F.lower(line).rlike(boilerplate_pattern(rules.phrases))
    return punctuation | navigation | boilerplate


def apply_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents with their counts, their verdict and ``clean_text``, the text without failing lines.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_bad_lines,
    lost_chars, kept, clean_text.
    """
    whole = text_of(text)
    lines = F.split(whole, "\n", -1)
    word_lines = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # one struct per row, bound once: its parts are used by several results
    parts = let(words_of(whole), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"), repeat_words(words, rules.window).alias("n_repeat_words"),
    ))
    dup_lines = let(word_lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    judged = let(
        F.transform(lines, lambda line: F.struct(line.alias("line"), line_fails(line, rules).alias("bad"))),
        lambda x: F.struct(
            F.size(F.filter(x, lambda e: e["bad"])).cast("long").alias("n_bad_lines"),
            F.aggregate(
                F.filter(x, lambda e: e["bad"]), F.lit(0).cast("long"), lambda a, e: a + visible(e["line"])
            ).alias("lost_chars"),
            F.array_join(F.transform(F.filter(x, lambda e: ~e["bad"]), lambda e: e["line"]), "\n").alias("clean_text"),
        ),
    )
    added = docs.withColumns({
        "__parts": parts, "__judged": judged, "word_chars": visible(whole),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": dup_lines,
    })
    added = added.withColumns({
        "n_words": F.col("__parts.n_words"), "n_repeat_words": F.col("__parts.n_repeat_words"),
        "n_bad_lines": F.col("__judged.n_bad_lines"), "lost_chars": F.col("__judged.lost_chars"),
        "clean_text": F.col("__judged.clean_text"),
    }).drop("__parts", "__judged")
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    return added.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_loss_percent)
    )


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with their failing lines removed; same columns as the input."""
    judged = apply_rules(docs.select(F.struct("*").alias("doc"), F.col("text")), rules).where("kept")
    changed = judged.select("doc.*", F.when(F.col("n_bad_lines") > 0, F.col("clean_text")).alias("__text"))
    new = {"text": F.coalesce("__text", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(
            F.length("__text")).cast(kind)
    return changed.withColumns(new).select(*docs.columns)
