"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of five words in a row that lies below a fixed fraction of the hash range, and
in any case the smallest one, so that short texts have a sketch too.  Its size grows with the text, so the
share of hashes found again estimates resemblance and containment however unequal two texts are.
Sketches merge: the union of two sketches, cut at the threshold again (or to its smallest hash), is the
sketch of both texts' shingles together.

All of it is column expressions.  Defined results: NULL text counts as empty; a text of fewer than five
words has one shingle, a text without a word an empty sketch; two empty sketches are alike (1), an empty
and another one are not (0); equal texts have equal fingerprints; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.functions.base import let
from tertulia.llm.common import text_of, window_hashes, words_of

WIDTH = 5
FRACTION = 1 / 8
# Neighbour search: at most so many ranges of ids, whose first rows are broadcast (8 bytes each).
MAX_RANGES = 1 << 15
MIN_RANGE = 1024


def kept(hashes: Column, fraction: float = FRACTION) -> Column:
    """Hashes below the threshold, sorted and distinct; the smallest one where there is none."""
    limit = -(1 << 63) + int(fraction * (1 << 64))
    low = F.filter(hashes, lambda h: h < F.lit(limit).cast("long"))
    smallest = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return let(low, lambda x: F.when(F.size(x) > 0, F.sort_array(F.array_distinct(x))).otherwise(smallest))


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    return let(window_hashes(words_of(text), width), lambda h: kept(h, fraction))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of the shingles of both."""
    return let(F.array_union(a, b), lambda h: kept(h, fraction))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all shingles of both, 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds, 0 to 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(hashes: Column) -> Column:
    """Sixteen hex digits per hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """The documents with ``sketch`` (array of hashes) and ``fingerprint`` (the same as hex text)."""
    added = docs.withColumn("sketch", sketch(text_of(text), width, fraction))
    return added.withColumn("fingerprint", as_text(F.col("sketch")))


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows in descending order of ``key``; after the last comes the first.

    Rows are dealt to ranges of keys, at most ``MAX_RANGES``, and each range also gets the first row of the
    range below it, so that one shuffle suffices and no task sorts all rows.  Rows with equal keys follow
    each other in descending order of ``columns``; NULL keys come last.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(MIN_RANGE, -(-((high or 0) - (low or 0) + 1) // MAX_RANGES))
    part = F.coalesce(F.floor((F.col(key) - F.lit(low)) / width), F.lit(-1)).cast("long")
    rows = df.withColumn("__range", part)
    heads = rows.groupBy("__range").agg(F.max(key).alias("__key"))  # MAX_RANGES + 1 rows at most
    down = Window.orderBy("__range")
    to = F.coalesce(F.lead("__range").over(down), F.first("__range").over(
        down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("__key", to.alias("__to"))
    guests = df.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("__key"))).drop("__key").withColumnRenamed("__to", "__range")
    both = rows.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1)))
    order = Window.partitionBy("__range").orderBy("__guest", F.desc_nulls_last(key), *[F.desc(c) for c in columns])
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
        .where("__guest = 0").drop("__range", "__guest")
    )
