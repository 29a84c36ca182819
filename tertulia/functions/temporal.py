"""Timestamps, hours and weekdays as column expressions."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from tertulia.fixed_values import WEEKDAYS_ES
from tertulia.functions import patterns as P
from tertulia.functions.base import let

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _month_number(name: Column) -> Column:
    """1 to 12 from an English month name or its first letters (three at least)."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.lit(m).startswith(low) | ((m == "september") & (low == "sept")), F.lit(i + 1)) for i, m in enumerate(_MONTHS)])


def parse_chat_timestamp(
    text: Column, date_order: str = "mdy_fallback", pivot_year: int | None = None
) -> Column:
    """Timestamp of a message header or of another common form; NULL when it is no valid moment.

    Read are numbers with ``/``, ``-`` or ``.`` between them, year first or last; English month names
    before or after the day; ISO texts.  The time may be missing (midnight) or have seconds and am/pm.

    ``mdy_fallback`` reads the month first and falls back to day first when the first
    number exceeds 12; ``dmy`` always reads the day first.  Two-digit years are placed
    within fifty years of ``pivot_year`` (default: this year).
    """
    if date_order not in ("mdy_fallback", "dmy"):
        raise ValueError(f"unknown date_order: {date_order}")
    this_year = pivot_year or datetime.date.today().year
    century = this_year - this_year % 100

    def parts(pattern: str, groups: str) -> Column:
        # One pass of the expression: groups become a list, which no matching text is.
        return F.split(F.regexp_replace(text, pattern, groups), "\x01", -1)

    def full_year(digits: Column) -> Column:
        year = digits.try_cast("int")
        guess = year + century
        return (
            F.when(F.length(digits) == 4, year)
            .when(F.length(digits) == 2, F.when(guess >= this_year + 50, guess - 100)
                  .when(guess < this_year - 50, guess + 100).otherwise(guess))
        )

    def moment(year: Column, month: Column, day: Column, p: Column, at: int) -> Column:
        part = lambda i: F.when(p[at + i] == "", F.lit(0)).otherwise(p[at + i].try_cast("int"))
        half, read, second = F.lower(p[at + 3]), part(0), part(2)
        hour = (
            F.when(half == "", read).when(read > 12, F.lit(None))
            .otherwise(read % 12 + F.when(half == "p", 12).otherwise(0))
        )
        return F.when(second < 60, F.try_make_timestamp_ntz(
            year, month, day, hour, part(1), second.cast("decimal(8,6)")))

    def numbers(p: Column) -> Column:
        first, second = p[0].try_cast("int"), p[1].try_cast("int")
        day_first = F.lit(True) if date_order == "dmy" else first > 12
        month, day = F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)
        return moment(full_year(p[2]), month, day, p, 3)

    def form(pattern: str, groups: str, read: Callable[[Column], Column]) -> Column:
        return let(parts(pattern, groups), lambda p: F.when(F.size(p) == 7, read(p)))

    plain = lambda c: c.try_cast("int")
    forms = [
        (P.CHAT_TIMESTAMP, "$1\x01$3\x01$4\x01$5\x01$6\x01$7\x01$8", numbers),
        (P.YEAR_FIRST, "$1\x01$3\x01$4\x01$5\x01$6\x01$7\x01$8", lambda p: moment(plain(p[0]), plain(p[1]), plain(p[2]), p, 3)),
        (P.MONTH_FIRST, "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7", lambda p: moment(plain(p[2]), _month_number(p[0]), plain(p[1]), p, 3)),
        (P.DAY_MONTH, "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7", lambda p: moment(plain(p[2]), _month_number(p[1]), plain(p[0]), p, 3)),
    ]
    found = [form(*f) for f in forms]
    iso = F.when(text.rlike(P.ISO_DATE_START), text.try_cast("timestamp_ntz"))
    return F.coalesce(found[0], iso, *found[1:])


def message_hour(moment: Column) -> Column:
    return F.hour(moment)


def message_weekday_index(moment: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(moment)


def message_weekday(moment: Column, labels: Sequence[str] = WEEKDAYS_ES) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in labels]), F.weekday(moment) + 1)
