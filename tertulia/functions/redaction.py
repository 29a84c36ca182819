"""Masking of sensitive text, as stateless column expressions.

``redact_text`` applies the steps in their contractual order: direction marks, bracketed
mentions, phone numbers, mail addresses, tilde names, and then either the presented-speaker
rule or person names, the last two with URLs and emojis set aside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from tertulia.fixed_values import (
    BLOCKED_NAME_WORDS,
    MAIL_MASK,
    NAME_EXCEPTIONS,
    NAME_MASK,
    NUMBER_MASK,
)
from tertulia.functions import patterns as P
from tertulia.functions.base import as_text, let

Detector = Callable[[Column], Column]

MASKS = {"name": NAME_MASK, "number": NUMBER_MASK, "mail": MAIL_MASK}


def _replace_if(sign: str, pattern: str, mask: str) -> Callable[[Column], Column]:
    """Replacement that looks for a pattern only in texts with the sign it needs."""
    return lambda text: let(
        text,
        lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, mask)).otherwise(t),
    )


def redact_marks(text: Column) -> Column:
    return F.translate(text, P.TEXT_MARKS, "")


redact_brackets = _replace_if("[", P.BRACKETED, NAME_MASK)
redact_phones = _replace_if("+", P.PHONE, NUMBER_MASK)
redact_emails = _replace_if("@", P.MAIL, MAIL_MASK)
redact_tilde_names = _replace_if("~", P.TILDE_NAME, NAME_MASK)


# --- person names ---------------------------------------------------------------------


def capitalised_names(text: Column) -> Column:
    """Default detector: runs of two or more capitalised words, in text order."""
    return F.regexp_extract_all(text, F.lit(P.NAME_CANDIDATE), F.lit(0))


def listed_names(names: Sequence[str]) -> Detector:
    """Detector for a caller's list of full names (a small list, kept in the plan)."""
    listed = F.array(*[F.lit(n) for n in names])
    return lambda text: F.filter(listed, lambda name: F.contains(text, name))


def keep_name(
    span: Column,
    exceptions: Sequence[str] = NAME_EXCEPTIONS,
    blocked: Sequence[str] = BLOCKED_NAME_WORDS,
) -> Column:
    """Whether a detected span is to be masked, i.e. is no false positive."""
    words = F.regexp_extract_all(span, F.lit(P.NON_BLANK_RUN), F.lit(0))
    keep = F.size(words) >= 2
    if blocked:
        keep = keep & ~F.exists(words, lambda w: w.isin(*blocked)) & ~span.isin(*blocked)
    if exceptions:
        phrases = F.array(*[F.lit(p.lower()) for p in exceptions])
        lowered = F.lower(span)
        keep = keep & ~span.isin(*exceptions) & ~F.exists(
            phrases, lambda p: F.contains(lowered, p) | F.contains(p, lowered)
        )
    return keep


def without_titles(text: Column) -> Column:
    """The text a detector sees: academic titles are left out for detection only."""
    return F.regexp_replace(text, P.TITLE_PREFIX, "")


def name_spans(
    text: Column,
    detector: Detector = capitalised_names,
    exceptions: Sequence[str] = NAME_EXCEPTIONS,
    blocked: Sequence[str] = BLOCKED_NAME_WORDS,
) -> Column:
    """Spans to mask, in text order."""
    found = detector(without_titles(text))
    return F.filter(found, lambda span: keep_name(span, exceptions, blocked))


def _mask_spans(text: Column, spans: Column) -> Column:
    # From the last span to the first: the order shows when one span contains another.
    return F.aggregate(
        F.reverse(spans), text, lambda acc, span: F.replace(acc, span, F.lit(NAME_MASK))
    )


# --- protected text -------------------------------------------------------------------


def _outcome(text: Column, skipped: Column | None = None) -> Column:
    dropped = F.lit(0) if skipped is None else skipped
    return F.struct(text.alias("text"), dropped.cast("int").alias("skipped"))


def _put_back(outcome: Column, found: Column) -> Column:
    # The n-th slot left in the text stands for the (skipped + n)-th protected span.
    pieces = F.split(outcome["text"], P.SLOT, -1)
    return F.when(F.size(found) == 0, outcome["text"]).otherwise(
        F.array_join(
            F.transform(
                pieces,
                lambda piece, i: F.concat(
                    piece, F.coalesce(F.get(found, i + outcome["skipped"]), F.lit(""))
                ),
            ),
            "",
        )
    )


def protected_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.PROTECTED), F.lit(0))


def open_text(text: Column, found: Column) -> Column:
    """The text with a slot for each protected span."""
    replaced = F.regexp_replace(text, P.PROTECTED, P.SLOT)
    return F.when(F.size(found) == 0, text).otherwise(replaced)


def _with_protection(text: Column, work: Callable[[Column], Column]) -> Column:
    """Run ``work`` on the text with every URL and emoji replaced by a slot."""
    return let(
        protected_spans(text),
        lambda found: let(let(open_text(text, found), work), lambda out: _put_back(out, found)),
    )


def _speaker_or(opened: Column, otherwise: Callable[[Column], Column]) -> Column:
    topic = F.concat(F.lit(f"{NAME_MASK} - "), F.regexp_extract(opened, P.SPEAKER_TOPIC, 1))
    lead = F.regexp_extract(opened, P.SPEAKER_LEAD, 1)
    return (
        F.when(~opened.rlike(P.SPEAKER), otherwise(opened))
        .when(
            opened.rlike(P.SPEAKER_TOPIC),
            _outcome(topic, F.regexp_count(lead, F.lit(P.SLOT))),
        )
        .otherwise(_outcome(opened))
    )


def redact_speaker_lines(text: Column) -> Column:
    """``Dra. Maria Perez - topic`` becomes the name mask and the topic."""
    return _with_protection(text, lambda t: _speaker_or(t, _outcome))


def redact_person_names(
    text: Column,
    detector: Detector = capitalised_names,
    exceptions: Sequence[str] = NAME_EXCEPTIONS,
    blocked: Sequence[str] = BLOCKED_NAME_WORDS,
) -> Column:
    """Replace every occurrence of every accepted person name."""
    return _with_protection(
        text,
        lambda t: _outcome(_mask_spans(t, name_spans(t, detector, exceptions, blocked))),
    )


def plain_masks(text: Column, null_text: str | None = None) -> Column:
    """The steps that need no protected spans: marks, mentions, numbers, mails, tilde names."""
    masked = redact_marks(as_text(text, null_text))
    for step in (redact_brackets, redact_phones, redact_emails, redact_tilde_names):
        masked = step(masked)
    return masked


def speaker_or_names(opened: Column, spans: Column, found: Column) -> Column:
    """Last step on opened text, with the accepted name spans given; URLs and emojis return."""
    outcome = _speaker_or(opened, lambda t: _outcome(_mask_spans(t, spans)))
    return let(outcome, lambda out: _put_back(out, found))


def redact_text(
    text: Column,
    detector: Detector | None = capitalised_names,
    exceptions: Sequence[str] = NAME_EXCEPTIONS,
    blocked: Sequence[str] = BLOCKED_NAME_WORDS,
    null_text: str | None = None,
) -> Column:
    """All masking steps in order; ``detector=None`` leaves person names alone.

    The detector must be a plain expression here; for a Python model see
    ``operators.names.redact_with_model``.
    """

    def names(opened: Column) -> Column:
        if detector is None:
            return _outcome(opened)
        return _outcome(_mask_spans(opened, name_spans(opened, detector, exceptions, blocked)))

    return let(
        plain_masks(text, null_text),
        lambda m: _with_protection(m, lambda t: _speaker_or(t, names)),
    )
