"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.fixed_values import WHITE_SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Nested column functions repeat their argument; binding it to a lambda variable keeps a
    chain of regular expressions from being evaluated several times per row.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(col: Column) -> Column:
    """Remove white space (as ``str.strip`` sees it) from both ends."""
    return F.trim(col, F.lit(WHITE_SPACE))


def blanks_only(text: Column, others: str = "") -> Column:
    """All white space, and the characters of ``others``, as blanks."""
    marks = WHITE_SPACE + others
    return F.translate(text, marks, " " * len(marks))


def exploded(df: DataFrame, keep: Sequence[str], array: Column, *names: str) -> DataFrame:
    """One row per element (with its position, when two names are given).

    Empty arrays are dropped after the explosion.  The plain form makes Spark test the array
    for emptiness first, which evaluates its whole expression again.
    """
    explode = F.posexplode_outer(array) if len(names) == 2 else F.explode_outer(array)
    return df.select(*keep, explode.alias(*names)).where(F.col(names[-1]).isNotNull())


def as_text(col: Column, null_text: str | None = None) -> Column:
    """Cast to string; with ``null_text`` a NULL counts as that text instead of NULL."""
    text = col.cast("string")
    return text if null_text is None else F.coalesce(text, F.lit(null_text))
