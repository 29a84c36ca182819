"""Which of day and month comes first in a chat's timestamps, found from the order of its messages.

Exports list messages in the order they were sent, so the right reading hardly ever runs backwards.  Both orders are scored
by their backward steps and by the timestamps they cannot read; fewer wins.  Steps are counted inside blocks of messages,
and between blocks from one row per block, so no chat is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tertulia.functions.temporal import parse_chat_timestamp

MONTH_FIRST, DAY_FIRST = "mdy_fallback", "dmy"
BLOCK_MESSAGES = 1 << 16


def infer_date_order(messages: DataFrame, order: str = "msg_idx", block: int = BLOCK_MESSAGES) -> DataFrame:
    """Per chat: chat_id, date_order, ambiguous, and back_/unread_ counts of both orders.

    ``order`` numbers the messages of a chat.  Equal scores are ambiguous and read month first; timestamps no order can read
    count against both.  NULL chats are a chat.
    """
    text = F.col("timestamp")
    read = messages.select(
        "chat_id", F.col(order).alias("spot"), F.floor(F.col(order) / block).alias("block"),
        parse_chat_timestamp(text, MONTH_FIRST).alias("m"), parse_chat_timestamp(text, DAY_FIRST).alias("d"))
    inside = Window.partitionBy("chat_id", "block").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    kinds = ("m", "d")
    stepped = read.select("*", *[F.last(k, ignorenulls=True).over(inside).alias(f"before_{k}") for k in kinds])
    first = lambda k: F.min_by(k, F.when(F.col(k).isNotNull(), F.col("spot")))
    last = lambda k: F.max_by(k, F.when(F.col(k).isNotNull(), F.col("spot")))
    blocks = stepped.groupBy("chat_id", "block").agg(
        *[F.count_if(F.col(k) < F.col(f"before_{k}")).alias(f"back_{k}") for k in kinds],
        *[F.count_if(F.col(k).isNull()).alias(f"unread_{k}") for k in kinds],
        *[first(k).alias(f"first_{k}") for k in kinds], *[last(k).alias(f"last_{k}") for k in kinds])
    earlier = Window.partitionBy("chat_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    crossed = [(F.col(f"first_{k}") < F.last(f"last_{k}", ignorenulls=True).over(earlier)).alias(f"cross_{k}") for k in kinds]
    scored = blocks.select("*", *crossed).groupBy("chat_id").agg(
        *[(F.sum(f"back_{k}") + F.count_if(f"cross_{k}")).alias(f"back_{n}") for k, n in (("m", "mdy"), ("d", "dmy"))],
        *[F.sum(f"unread_{k}").alias(f"unread_{n}") for k, n in (("m", "mdy"), ("d", "dmy"))])
    month, day = F.col("back_mdy") + F.col("unread_mdy"), F.col("back_dmy") + F.col("unread_dmy")
    return scored.select(
        "chat_id", F.when(day < month, DAY_FIRST).otherwise(MONTH_FIRST).alias("date_order"), (day == month).alias("ambiguous"),
        "back_mdy", "back_dmy", "unread_mdy", "unread_dmy")


def with_inferred_moment(messages: DataFrame, order: str = "msg_idx") -> DataFrame:
    """Adds ``moment``, each chat's timestamps read in its own order."""
    orders = infer_date_order(messages, order).select(F.col("chat_id").alias("_chat"), (F.col("date_order") == DAY_FIRST).alias("_day_first"))
    text = F.col("timestamp")
    joined = messages.join(orders, F.col("chat_id").eqNullSafe(F.col("_chat")), "left")
    moment = F.when(F.col("_day_first"), parse_chat_timestamp(text, DAY_FIRST)).otherwise(parse_chat_timestamp(text, MONTH_FIRST))
    return joined.withColumn("moment", moment).drop("_chat", "_day_first")
