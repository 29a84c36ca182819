"""Temporal metrics: weekday, hour, hour by weekday, peaks, range.

System messages count here, as in the text metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tertulia.fixed_values import WEEKDAYS_ES
from tertulia.functions.temporal import message_weekday, parse_chat_timestamp
from tertulia.operators.date_order import with_inferred_moment

_DAYS_AND_HOURS = 7 * 24


def with_moment(messages: DataFrame, date_order: str = "mdy_fallback") -> DataFrame:
    """Adds ``moment`` from the timestamp column, which may be text or already a timestamp.

    ``date_order="infer"`` finds the order of each chat (columns chat_id and msg_idx) from its messages' order.
    """
    stamp = F.col("timestamp")
    kind = messages.schema["timestamp"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return messages.withColumn("moment", stamp.cast("timestamp_ntz"))
    if date_order == "infer":
        return with_inferred_moment(messages)
    return messages.withColumn("moment", parse_chat_timestamp(stamp, date_order))


def _counted(messages: DataFrame, by: Sequence[str], date_order: str, undated: bool = False) -> DataFrame:
    """Rows and non-null messages per (by, weekday, hour): at most 168 rows per group.

    With ``undated``, rows without a valid date stand in one more row without day and hour.
    """
    timed = with_moment(messages, date_order)
    timed = timed if undated else timed.where(F.col("moment").isNotNull())
    value = "message" if "message" in messages.columns else messages.columns[0]
    return timed.groupBy(
        *by, F.weekday("moment").alias("day_idx"), F.hour("moment").alias("hour")
    ).agg(F.count("*").alias("n"), F.count(value).alias("n_messages"))


def _label(labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in labels]), F.col("day_idx") + 1).alias("day_name")


def _dense(counted: DataFrame, key: str, size: int, by: Sequence[str]) -> DataFrame:
    """One row for each key 0..size-1, zeros included, without a join."""
    per_key = [F.coalesce(F.sum(F.when(F.col(key) == i, F.col("n"))), F.lit(0)) for i in range(size)]
    return counted.groupBy(*by).agg(F.array(*per_key).alias("counts")).select(
        *by, F.posexplode("counts").alias(key, "count")
    )


def messages_by_day(
    messages: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence[str] = WEEKDAYS_ES,
    date_order: str = "mdy_fallback",
) -> DataFrame:
    """All seven weekdays in order, zeros kept, also for groups without any valid date."""
    dense = _dense(_counted(messages, by, date_order, undated=True), "day_idx", 7, by)
    return dense.select(*by, "day_idx", _label(labels), "count").orderBy(*by, "day_idx")


def messages_by_hour(
    messages: DataFrame, by: Sequence[str] = (), dense: bool = False, date_order: str = "mdy_fallback"
) -> DataFrame:
    """Hours that occur, or all of 0..23 with ``dense``."""
    if dense:
        return _dense(_counted(messages, by, date_order, undated=True), "hour", 24, by).orderBy(*by, "hour")
    counted = _counted(messages, by, date_order)
    return counted.groupBy(*by, "hour").agg(F.sum("n").alias("count")).orderBy(*by, "hour")


def activity_heatmap(
    messages: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence[str] = WEEKDAYS_ES,
    date_order: str = "mdy_fallback",
) -> DataFrame:
    """Non-null messages per hour (rows that occur) and weekday (seven columns)."""
    cells = _counted(messages, by, date_order).select(*by, "hour", _label(labels), "n_messages")
    return (
        cells.groupBy(*by, "hour")
        .pivot("day_name", list(labels))
        .agg(F.sum("n_messages"))
        .na.fill(0, subset=list(labels))
        .orderBy(*by, "hour")
    )


def activity_peaks(
    messages: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence[str] = WEEKDAYS_ES,
    date_order: str = "mdy_fallback",
) -> DataFrame:
    """Busiest and quietest day, busiest hour, busiest cell; ties go to the earlier one."""
    cells = _counted(messages, by, date_order)
    # At most 168 cells a group, so the whole week fits one row.
    week = cells.groupBy(*by).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("day_idx") == d, F.col("n"))), F.lit(0)) for d in range(7)]).alias("days"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n"))), F.lit(0)) for h in range(24)]).alias("hours"),
        F.max(
            F.struct("n", (_DAYS_AND_HOURS - F.col("day_idx") * 24 - F.col("hour")).alias("early"), "day_idx", "hour")
        ).alias("cell"),
    )
    day = lambda i: F.element_at(F.array(*[F.lit(d) for d in labels]), (i + 1).cast("int"))
    first = lambda xs, x: (F.array_position(xs, x) - 1).cast("int")
    most, least = F.array_max("days"), F.array_min("days")
    hour_most = F.array_max("hours")
    kinds = F.array(
        F.struct(F.lit("busiest_day").alias("peak"), day(first("days", most)).alias("day_name"),
                 F.lit(None).cast("int").alias("hour"), most.alias("count")),
        F.struct(F.lit("quietest_day").alias("peak"), day(first("days", least)).alias("day_name"),
                 F.lit(None).cast("int").alias("hour"), least.alias("count")),
        F.struct(F.lit("busiest_hour").alias("peak"), F.lit(None).cast("string").alias("day_name"),
                 first("hours", hour_most).alias("hour"), hour_most.alias("count")),
        F.struct(F.lit("busiest_cell").alias("peak"), day(F.col("cell.day_idx")).alias("day_name"),
                 F.col("cell.hour").alias("hour"), F.col("cell.n").alias("count")),
    )
    return week.select(*by, F.inline(kinds))


def date_range(messages: DataFrame, by: Sequence[str] = (), date_order: str = "mdy_fallback") -> DataFrame:
    timed = with_moment(messages, date_order)
    return timed.groupBy(*by).agg(
        F.min("moment").alias("first_message"),
        F.max("moment").alias("last_message"),
        F.count("moment").alias("dated_messages"),
    )


def with_calendar(
    messages: DataFrame, labels: Sequence[str] = WEEKDAYS_ES, date_order: str = "mdy_fallback"
) -> DataFrame:
    """Adds ``moment, hour, day_idx, day_name``."""
    return with_moment(messages, date_order).withColumns({
        "hour": F.hour("moment"),
        "day_idx": F.weekday("moment"),
        "day_name": message_weekday(F.col("moment"), labels),
    })
