"""Member metrics.  System messages never count; ties are broken by the sender."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.fixed_values import SYSTEM_SENDER
from tertulia.functions.base import as_text, blanks_only
from tertulia.operators.ranking import top_rows


def exclude_system(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("sender") != SYSTEM_SENDER)


def word_count(messages: DataFrame, null_text: str | None = None) -> Column:
    """Words between white space; a column of that name is reused."""
    if "word_count" in messages.columns:
        return F.col("word_count")
    return F.array_size(F.array_remove(F.split(blanks_only(as_text(F.col("message"), null_text)), " "), ""))


def message_size(messages: DataFrame, null_text: str | None = None, reuse: bool = True) -> Column:
    """Characters (code points); a column of that name is reused."""
    if reuse and "message_size" in messages.columns:
        return F.col("message_size")
    return F.length(as_text(F.col("message"), null_text))


def with_word_count(messages: DataFrame, null_text: str | None = None) -> DataFrame:
    return messages.withColumn("word_count", word_count(messages, null_text))


def with_message_size(messages: DataFrame, null_text: str | None = None) -> DataFrame:
    return messages.withColumn("message_size", message_size(messages, null_text))


def top_active_members(messages: DataFrame, top_n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    counted = exclude_system(messages).groupBy(*by, "sender").agg(F.count("*").alias("count"))
    return top_rows(counted, top_n, [F.desc("count"), F.asc("sender")], by)


def avg_user_word_count(
    messages: DataFrame, top_n: int = 10, by: Sequence[str] = (), null_text: str | None = None
) -> DataFrame:
    mean = F.avg(word_count(messages, null_text)).alias("word_count")
    means = exclude_system(messages).groupBy(*by, "sender").agg(mean)
    return top_rows(means, top_n, [F.desc("word_count"), F.asc("sender")], by)


def _statistics(messages: DataFrame, by: Sequence[str], null_text: str | None, reuse: bool) -> DataFrame:
    sized = exclude_system(messages).select(
        *by, "sender", "message", message_size(messages, null_text, reuse).alias("size")
    )
    return sized.groupBy(*by, "sender").agg(
        F.count("message").alias("total_messages"),
        F.sum("size").alias("total_characters"),
        F.avg("size").alias("avg_message_size"),
    )


def user_statistics(
    messages: DataFrame, by: Sequence[str] = (), null_text: str | None = None, ordered: bool = True, reuse: bool = False
) -> DataFrame:
    """Messages, characters and mean size per member; ``reuse`` takes sizes from a column message_size."""
    stats = _statistics(messages, by, null_text, reuse)
    return top_rows(stats, None, [F.desc("total_messages"), F.asc("sender")], by) if ordered else stats


def users_short_messages(
    messages: DataFrame, top_n: int = 10, by: Sequence[str] = (), null_text: str | None = None
) -> DataFrame:
    stats = _statistics(messages, by, null_text, reuse=True).select(
        *by, "sender", "avg_message_size", "total_messages"
    )
    return top_rows(stats, top_n, [F.asc("avg_message_size"), F.asc("sender")], by)


def size_histogram(
    messages: DataFrame, by: Sequence[str] = (), null_text: str | None = None, reuse: bool = False
) -> DataFrame:
    """Messages per (sender, size): small whatever the number of messages."""
    return (
        exclude_system(messages)
        .select(
            *by, "sender", message_size(messages, null_text, reuse).alias("size"),
            F.col("message").isNotNull().alias("present"),
        )
        .groupBy(*by, "sender", "size")
        .agg(F.count("*").alias("n"), F.count_if("present").alias("n_present"))
    )


def message_size_boxplot(
    messages: DataFrame, top_n: int = 10, by: Sequence[str] = (), null_text: str | None = None, reuse: bool = False
) -> DataFrame:
    """Box-plot numbers of the ``top_n`` most active members, in that order.

    Quartiles interpolate linearly; whiskers end at the last value within 1.5 times the
    interquartile range.  Messages are read once, into a size histogram per member.
    """
    keys = [*by, "sender"]
    sizes = size_histogram(messages, by, null_text, reuse)
    # rank on sums first: only the members shown get quartiles
    totals = sizes.groupBy(*keys).agg(F.sum("n_present").alias("total_messages"))
    top = top_rows(totals, top_n, [F.desc("total_messages"), F.asc("sender")], by)
    quartile = lambda q: F.percentile("size", F.lit(q), F.col("n"))
    boxes = (
        sizes.alias("a").join(top.alias("b"), _same(keys), "left_semi")
        .groupBy(*keys)
        .agg(
            F.sum("n_present").alias("total_messages"),
            quartile(0.25).alias("q1"),
            quartile(0.5).alias("median"),
            quartile(0.75).alias("q3"),
            # A member's distinct sizes: bounded by the longest message, not by the messages.
            F.array_sort(F.collect_set("size")).alias("sizes"),
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low = F.array_min(F.filter("sizes", lambda s: s >= F.col("q1") - reach))
    high = F.array_max(F.filter("sizes", lambda s: s <= F.col("q3") + reach))
    return top_rows(boxes, top_n, [F.desc("total_messages"), F.asc("sender")], by).select(
        *keys, "total_messages", "q1", "median", "q3",
        F.least(low, F.col("q1")).alias("whisker_low"),
        F.greatest(high, F.col("q3")).alias("whisker_high"),
    )


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def messages_of_top_members(messages: DataFrame, top_n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """All messages of the ``top_n`` most active members."""
    keys = [*by, "sender"]
    counts = exclude_system(messages).groupBy(*keys).agg(F.count("message").alias("n"))
    top = top_rows(counts, top_n, [F.desc("n"), F.asc("sender")], by).select(*keys)
    return messages.alias("a").join(top.alias("b"), _same(keys), "left_semi")


def participation_profile(
    messages: DataFrame, quantile: float = 0.75, null_text: str | None = None, by: Sequence[str] = (), reuse: bool = False
) -> DataFrame:
    """Labels members by volume and length: few-but-long against many-but-short writers.

    A member is high in volume (long in style) when at or above the ``quantile`` of all
    members' message counts (whole-character mean sizes).  Both thresholds are exact; they
    come from value counts instead of an ordering of all members.
    """
    stats = user_statistics(messages, by, null_text, ordered=False, reuse=reuse)
    volume, length = F.col("total_messages"), F.floor("avg_message_size")
    # members per (group, volume, length): both quantiles come from these counts
    counted = stats.groupBy(*by, volume.alias("v"), length.alias("l")).agg(F.count("*").alias("n"))
    limits = [F.percentile(c, F.lit(quantile), F.col("n")).alias(f"{c}_limit") for c in ("v", "l")]
    if by:
        found = stats.alias("a").join(counted.groupBy(*by).agg(*limits).alias("b"), _same(by)).select("a.*", "v_limit", "l_limit")
        many, long = volume >= F.col("v_limit"), length >= F.col("l_limit")
    else:
        one = counted.agg(F.struct(*limits)).scalar()
        found, many, long = stats, volume >= one["v_limit"], length >= one["l_limit"]
    label = (
        F.when(many & long, "many_long")
        .when(many, "many_short")
        .when(long, "few_long")
        .otherwise("few_short")
    )
    return found.select(*by, "sender", "total_messages", "avg_message_size", label.alias("profile"))
