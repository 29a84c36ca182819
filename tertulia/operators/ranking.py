"""Top-k and numbering without ordering a whole table or group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_rows(df: DataFrame, n: int | None, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows by ``order``; per group when ``by`` is given.

    The global form plans as TakeOrderedAndProject.  The grouped form filters on
    ``row_number``, which Spark cuts to ``n`` rows per group in every partition before the
    shuffle, so a hot group is never sorted as a whole.
    """
    if not by:
        ranked = df.orderBy(*order)
        return ranked if n is None else ranked.limit(n)
    if n is None:
        return df.orderBy(*by, *order)
    # The hash parts the groups at the first comparison of a sort, which names with a common start do not.
    spot = F.row_number().over(Window.partitionBy(F.xxhash64(*by), *by).orderBy(*order))
    return df.withColumn("_spot", spot).where(F.col("_spot") <= n).drop("_spot")


def running_offsets(counts: DataFrame, group: Sequence[str], order: Sequence[str], n: str, name: str) -> DataFrame:
    """Sum of ``n`` over the earlier rows of the group.

    ``counts`` holds one row per bounded block, so a group's window sees blocks, not rows.
    """
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(earlier), F.lit(0).cast("long")))
