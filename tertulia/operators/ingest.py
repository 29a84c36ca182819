"""From chat-export lines to a message table.

Lines carry ``(part, block, seq)``; a block is a bounded run of consecutive lines.  Messages are
assembled inside blocks, in parallel, after one shuffle of the text.  Only the first and
last message of each block can reach over a block's edge, so only those are shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.fixed_values import PSEUDONYM_PREFIX, SYSTEM_SENDER
from tertulia.functions import patterns as P
from tertulia.functions.base import let, strip
from tertulia.functions.redaction import Detector, redact_text
from tertulia.functions.text import sanitize_line
from tertulia.operators.names import redact_with_model
from tertulia.operators.ranking import running_offsets

BLOCK = ["chat_id", "part", "block"]
Redactor = Callable[[Column], Column]


def sanitize_lines(lines: DataFrame) -> DataFrame:
    """Blank physical lines dropped, the others sanitised into ``clean``."""
    return lines.where(strip(F.col("value")) != "").withColumn("clean", sanitize_line(F.col("value")))


def parse_chat_lines(lines: DataFrame, redact: Redactor | None = None) -> DataFrame:
    """Adds ``is_header, timestamp, sender, text`` to the non-blank lines.

    A header line holds a timestamp, a sender (the system sender when it names none) and
    the start of a message; any other line is text that continues a message.
    """
    redact = redact or (lambda c: c)
    # One pass of the expression: a header becomes its three groups, any other line stays as it is.
    marked = F.regexp_replace("clean", P.HEADER, "$1\x01$2\x01$3")
    groups = let(marked, lambda m: F.when(m != F.col("clean"), F.split(m, "\x01", 3)))
    sender = let(F.col("groups")[1], lambda s: F.when(s == "", F.lit(SYSTEM_SENDER)).otherwise(strip(s)))
    return (
        sanitize_lines(lines)
        .withColumn("groups", groups)
        .withColumn("is_header", F.col("groups").isNotNull())
        .withColumn("timestamp", F.col("groups")[0])
        .withColumn("sender", F.when(F.col("is_header"), sender))
        .withColumn("text", redact(F.when(F.col("is_header"), F.col("groups")[2]).otherwise(F.col("clean"))))
        # Keys without NULLs: no reader of these lines adds a filter of its own, so readers of
        # the same lines can share one shuffle.
        .select(
            F.coalesce("chat_id", F.lit("")).alias("chat_id"),
            F.coalesce("part", F.lit("")).alias("part"),
            F.coalesce("block", F.lit(0)).alias("block"),
            "seq", "is_header", "timestamp", "sender", "text",
        )
    )


def _carried(parsed: DataFrame) -> DataFrame:
    """Headers per block, the first one's place, and headers before it in its chat: one row per block."""
    per_block = parsed.groupBy(*BLOCK).agg(
        F.count_if("is_header").alias("headers"), F.min(F.when(F.col("is_header"), F.col("seq"))).alias("first_header"))
    return running_offsets(per_block, ["chat_id"], ["part", "block"], "headers", "before")


def early_blocks(parsed: DataFrame) -> DataFrame:
    """Blocks that no header of their chat stands before, and their first header's place."""
    return _carried(parsed).where(F.col("before") == 0).select(*BLOCK, "first_header")


def preamble_lines(parsed: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Lines before the first header of their chat, one row each: ``chat_id, part, block, seq, text``.

    An export whose lines no header matches consists of them, so they are never brought together.  ``blocks`` is
    ``early_blocks(parsed)``: staged, its size is known before the lines are joined with it, and a small one moves no text.
    """
    blocks = early_blocks(parsed) if blocks is None else blocks
    early = F.col("first_header").isNull() | (F.col("seq") < F.col("first_header"))
    return parsed.join(blocks, BLOCK).where(early).select(*BLOCK, "seq", "text")


def assemble_messages(parsed: DataFrame) -> DataFrame:
    """Joins continuation lines to their header: one row per message.

    ``msg_idx`` counts the headers of a chat from 1.  Lines before the first header belong
    to no message; ``preamble_lines`` returns them.
    """
    in_block = (
        Window.partitionBy(*BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pieces = (
        parsed.withColumn("local_idx", F.count_if("is_header").over(in_block))
        .groupBy(*BLOCK, "local_idx")
        .agg(
            F.max("timestamp").alias("timestamp"),
            F.max("sender").alias("sender"),
            F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("lines"),
        )
        .withColumn("message", F.array_join(F.col("lines.text"), "\n"))
        .drop("lines")
    )
    # The counts come from a second, cheap read of the lines.  Should the two reads ever
    # disagree about blocks, fail instead of numbering wrongly.
    counts = F.when(
        F.col("headers").isNull() | (F.col("local_idx") > F.col("headers")),
        F.raise_error(F.lit("blocks of the line scan changed between two reads")).cast("long"),
    ).otherwise(F.col("before"))
    numbered = (
        pieces.join(_carried(parsed), BLOCK, "left")
        .withColumn("msg_idx", counts + F.col("local_idx"))
        # Never NULL: a condition that drops NULLs would turn the join of one branch into another form, and the
        # branches would no longer share the shuffle of the lines.
        .withColumn("at_edge", (F.col("local_idx") == 0) | F.coalesce(F.col("local_idx") == F.col("headers"), F.lit(False)))
    )
    fields = ["chat_id", "msg_idx", "timestamp", "sender", "message"]
    inner = numbered.where(~F.col("at_edge")).select(*fields)
    edges = (
        numbered.where("at_edge").where(F.col("msg_idx") > 0)
        .groupBy("chat_id", "msg_idx")
        .agg(
            F.max("timestamp").alias("timestamp"),
            F.max("sender").alias("sender"),
            F.array_sort(F.collect_list(F.struct("part", "block", "message"))).alias("pieces"),
        )
        .withColumn("message", F.array_join(F.col("pieces.message"), "\n"))
        .select(*fields)
    )
    return inner.unionByName(edges)


def message_pieces(parsed: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """Messages of any length as ordered pieces: ``chat_id, msg_idx, at, timestamp, sender, text``.

    A piece is a run of whole lines of one message, at most ``max_chars`` characters together (a single longer line is a
    piece of its own).  ``at`` is where it starts in the message, in characters; the pieces by ``at``, joined by
    line breaks, are the message.  Timestamp and sender stand with the first piece (``at`` 0) and are NULL behind it.

    No row and no group grows with a message.  A line's place in its message is its place since the block's last header, or
    for lines before the first header of their block what earlier blocks carry over: a scan over one row per block
    of the characters since the last header.  Only pieces that a block's edge cuts are shuffled a second time.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    so_far = Window.partitionBy(*BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(lines: DataFrame, *more: str) -> DataFrame:
        sized = lines.select(*BLOCK, "seq", "is_header", *more, (F.length("text") + F.when(F.col("is_header"), 0).otherwise(1)).cast("long").alias("n"))
        return (
            sized.withColumn("local_idx", F.count_if("is_header").over(so_far)).withColumn("upto", F.sum("n").over(so_far))
            .withColumn("since", F.coalesce(F.max(F.when(F.col("is_header"), F.col("upto") - F.col("n"))).over(so_far), F.lit(0).cast("long")))
        )

    per_block = placed(parsed).groupBy(*BLOCK).agg(
        F.count_if("is_header").alias("headers"), (F.max("upto") - F.max("since")).alias("open"))
    blocks = running_offsets(running_offsets(per_block, ["chat_id"], ["part", "block"], "headers", "before"), ["chat_id"], ["part", "block"], "open", "total")
    # What is open at a block's start: all since the last block with a header, that block's own rest included.
    earlier = Window.partitionBy("chat_id").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(F.when(F.col("headers") > 0, F.col("total"))).over(earlier), F.lit(0).cast("long"))
    blocks = blocks.withColumn("carried", F.col("total") - last).drop("total", "open")
    missing = F.raise_error(F.lit("blocks of the line scan changed between two reads")).cast("long")
    start = F.col("upto") - F.col("n") - F.col("since") + F.when(F.col("local_idx") == 0, F.col("carried")).otherwise(0)
    bucket = lambda at: F.floor(at / max_chars)
    lines = (
        placed(parsed, "timestamp", "sender", "text").join(blocks, BLOCK, "left")
        .withColumn("msg_idx", F.when(F.col("headers").isNull() | (F.col("local_idx") > F.col("headers")), missing)
                    .otherwise(F.col("before") + F.col("local_idx")))
        .where(F.col("msg_idx") > 0).withColumn("at", start)
        # A line that crosses a multiple of the limit stands alone; between two multiples lines share a piece.
        .withColumn("piece", bucket(F.col("at")) + bucket(F.col("at") + F.greatest(F.col("n"), F.lit(1)) - 1))
    )
    told = [F.min("at").alias("at"), F.max("timestamp").alias("timestamp"), F.max("sender").alias("sender")]
    pieces = (
        lines.groupBy(*BLOCK, "local_idx", "headers", "msg_idx", "piece")
        .agg(*told, F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("lines"))
        .withColumn("text", F.array_join(F.col("lines.text"), "\n"))
    )
    # Never NULL, so that both branches share one shuffle of the lines (see ``assemble_messages``).
    at_edge = (F.col("local_idx") == 0) | F.coalesce(F.col("local_idx") == F.col("headers"), F.lit(False))
    fields = ["chat_id", "msg_idx", "at", "timestamp", "sender", "text"]
    edges = (
        pieces.where(at_edge).groupBy("chat_id", "msg_idx", "piece")
        .agg(*told, F.array_sort(F.collect_list(F.struct("part", "block", "text"))).alias("runs"))
        .withColumn("text", F.array_join(F.col("runs.text"), "\n"))
    )
    return pieces.where(~at_edge).select(*fields).unionByName(edges.select(*fields))


def pseudonyms(
    messages: DataFrame,
    prefix: str = PSEUDONYM_PREFIX,
    skip_system: bool = False,
    bucket_size: int = 65536,
) -> DataFrame:
    """``(chat_id, sender, pseudonym)``, numbered by first appearance in the chat.

    The system sender keeps its name but uses up a number unless ``skip_system``.
    """
    first = (
        messages.groupBy("chat_id", "sender").agg(F.min("msg_idx").alias("spot"))
        .withColumn("bucket", F.floor(F.col("spot") / bucket_size))
    )
    return _numbered(first, ["bucket"], prefix, skip_system)


def pseudonyms_of_lines(
    parsed: DataFrame, prefix: str = PSEUDONYM_PREFIX, skip_system: bool = False
) -> DataFrame:
    """The same from parsed lines, before any message is assembled."""
    return _numbered(_first_in_lines(parsed), ["part", "block"], prefix, skip_system)


def _first_in_lines(parsed: DataFrame) -> DataFrame:
    return (
        parsed.where("is_header")
        # Senders per block first, on plain numbers; few rows are left for the ordered minimum.
        .groupBy(*BLOCK, "sender").agg(F.min("seq").alias("seq"))
        .groupBy("chat_id", "sender").agg(F.min(F.struct("part", "block", "seq")).alias("first"))
        .select("chat_id", "sender", "first.part", "first.block", F.col("first.seq").alias("spot"))
    )


def new_pseudonyms(
    parsed: DataFrame, known: DataFrame, prefix: str = PSEUDONYM_PREFIX, skip_system: bool = False
) -> DataFrame:
    """``(chat_id, sender, pseudonym, number)`` of the senders that ``known``, a table of the same form, lacks.

    Numbers go on after the chat's largest known one, by first appearance, so no sender that has a pseudonym gets another.
    """
    first, old = _first_in_lines(parsed).alias("f"), known.alias("k")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("chat_id", "sender")]
    taken = known.groupBy(F.col("chat_id").alias("_chat")).agg(F.max("number").alias("_taken"))
    return _numbered(first.join(old, same, "left_anti"), ["part", "block"], prefix, skip_system, taken)


def _numbered(
    first: DataFrame, bucket: list[str], prefix: str, skip_system: bool, taken: DataFrame | None = None
) -> DataFrame:
    """Numbers first appearances within buckets and adds the counts of earlier buckets.

    A message brings in at most one sender, so a bucket of messages or lines bounds its window.  With ``taken`` (_chat,
    _taken) numbers start behind it and are returned, too.
    """
    is_system = F.col("sender") == SYSTEM_SENDER
    counted = first.where(~F.coalesce(is_system, F.lit(False))) if skip_system else first
    offsets = running_offsets(
        counted.groupBy("chat_id", *bucket).agg(F.count("*").alias("n")),
        ["chat_id"], bucket, "n", "offset",
    ).drop("n")
    if taken is not None:
        offsets = offsets.join(taken, F.col("chat_id").eqNullSafe(F.col("_chat")), "left").withColumn(
            "offset", F.col("offset") + F.coalesce("_taken", F.lit(0))).drop("_chat", "_taken")
    in_bucket = Window.partitionBy("c.chat_id", *[f"c.{b}" for b in bucket]).orderBy("spot")
    number = F.col("offset") + F.row_number().over(in_bucket)
    name = F.when(is_system, F.lit(SYSTEM_SENDER)).otherwise(F.concat(F.lit(prefix), F.col("number").cast("string")))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("chat_id", *bucket)]
    out = counted.alias("c").join(offsets.alias("o"), same).select("c.chat_id", "sender", number.cast("long").alias("number"))
    out = out.select("chat_id", "sender", name.alias("pseudonym"), "number")
    if skip_system:
        system = first.where(is_system).select(
            "chat_id", "sender", F.lit(SYSTEM_SENDER).alias("pseudonym"), F.lit(None).cast("long").alias("number"))
        out = out.unionByName(system)
    return out if taken is not None else out.drop("number")


def pseudonymize_senders(messages: DataFrame, names: DataFrame | None = None, **options) -> DataFrame:
    """Replaces senders by pseudonyms.

    NULL chats and senders count as a chat and a sender.  Not hinted: the name table grows with the data, so Spark broadcasts it only when its
    measured size allows and otherwise splits a hot sender's rows as a skewed join.
    """
    names = pseudonyms(messages, **options) if names is None else names
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("chat_id", "sender")]
    return messages.alias("m").join(names.alias("n"), same).select(
        "m.chat_id", "msg_idx", "timestamp", F.col("pseudonym").alias("sender"), "message"
    )


def render_anonymized(messages: DataFrame) -> DataFrame:
    """Output text lines: ``[timestamp] sender: text``, continuation lines bare."""
    text = F.format_string("[%s] %s: %s", "timestamp", "sender", "message")
    return messages.select(
        "chat_id", "msg_idx", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "value")
    )


def anonymize(
    lines: DataFrame, redact: Redactor = redact_text, model: Detector | None = None, **options
) -> DataFrame:
    """Lines to anonymised messages: parse, mask line by line, assemble, pseudonymise.

    With ``model``, a Python name detector, masking runs through it instead of ``redact``.
    """
    parsed = masked_lines(lines, redact, model)
    return pseudonymize_senders(assemble_messages(parsed), pseudonyms_of_lines(parsed, **options))


def masked_lines(lines: DataFrame, redact: Redactor = redact_text, model: Detector | None = None) -> DataFrame:
    if model is None:
        return parse_chat_lines(lines, redact)
    return redact_with_model(parse_chat_lines(lines), model, "text")
