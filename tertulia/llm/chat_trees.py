"""Chat formatting from reply trees.

Messages name the message they answer.  Ancestors are found by iterative self-joins that double the distance:
round k joins each message with the one 2^k steps above, adding up scores and lengths, so a chain of n
messages takes log2(n) rounds.  The leaves of a tree are its branches; they are ranked by mean
score, and the messages of the chosen branches are enumerated by walking the same jumps back, from the longest to the
shortest: each ancestor is reached once.  Every path becomes one conversation.

The result has one row per turn, so that a conversation of any length needs no row of its size: the formatted text of a
conversation is its ``piece`` values in order of ``pos``.  Turns are marked ``<|im_start|>role\\n ... <|im_end|>\\n``.  Inside
texts and roles each ``<`` before exclamation marks and a bar gets one exclamation mark more, so control strings occur
only as marks and ``unescape`` gives every text back.  The loss mask covers the escaped text of the trained roles.

Defined results: NULL text and role count as empty; a NULL tree id is a tree of its own; a message whose parent is
missing starts a path; of messages with the same id in a tree the one with the smallest parent, role and text counts; messages in
or below a cycle of parents have no root and are left out; ties in score go to the smaller id; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.llm.common import checkpointed

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", r"<!$1|")


def unescape(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text)


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    """Equality of trees (NULL is one) and of the given columns, for a join of aliases a and b."""
    found = F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    for x, y in pairs:
        found = found & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return found


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, path_rank, pos, id, role, text) for the ``top`` branches of each tree (all: None), best mean score first.

    ``messages``: tree, id, parent (NULL at a root), role, text, score.
    """
    one = checkpointed(messages.groupBy("tree", "id").agg(F.min(F.struct(
        F.col("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")).select("tree", "id", "m.*"))
    narrow = one.select("tree", "id", "parent", "score")
    known = narrow.select("tree", "id")
    steps = [checkpointed(narrow.alias("a").join(known.alias("b"), _same("a", "b", ("parent", "id")), "left").select(
        "a.tree", "a.id", F.col("b.id").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n")))]
    most = steps[0].groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(steps) - 1)) <= most and not steps[-1].where("up IS NOT NULL").isEmpty():
        # messages that know their root stand still
        a, b = steps[-1].where("up IS NOT NULL").alias("a"), steps[-1].alias("b")
        moved = a.join(b, _same("a", "b", ("up", "id"))).select(
            "a.tree", "a.id", "b.up", (F.col("a.sum") + F.col("b.sum")).alias("sum"), (F.col("a.n") + F.col("b.n")).alias("n"))
        steps.append(checkpointed(moved.unionByName(steps[-1].where("up IS NULL"))))
    parents = steps[0].where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = steps[-1].where("up IS NULL").alias("a").join(parents.alias("b"), _same("a", "b", ("id", "id")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), "id")
    ranked = leaves.withColumn("path_rank", F.row_number().over(best).cast("long"))
    walk = (ranked if top is None else ranked.where(F.col("path_rank") <= top)).select(
        "tree", F.col("id").alias("leaf"), "path_rank", "n", F.col("id").alias("at"), F.lit(0).cast("long").alias("far"))
    for k in reversed(range(len(steps) - 1)):
        jumps = steps[k].where("up IS NOT NULL").select("tree", "id", "up")
        here = F.struct("at", "far")
        above = F.struct(F.col("up").alias("at"), (F.col("far") + (1 << k)).alias("far"))
        walk = walk.alias("a").join(jumps.alias("b"), _same("a", "b", ("at", "id")), "left").select(
            "a.tree", "leaf", "path_rank", "n", F.explode(F.array(here, above)).alias("e")
        ).where("e.at IS NOT NULL").select("tree", "leaf", "path_rank", "n", "e.*")
    return walk.alias("a").join(one.alias("b"), _same("a", "b", ("at", "id"))).select(
        "a.tree", "leaf", "path_rank", (F.col("n") - 1 - F.col("far")).alias("pos"), "b.id", "role", "text")


def formatted(messages: DataFrame, top: int | None = 1, trained: tuple = TRAINED) -> DataFrame:
    """The chosen paths as (tree, leaf, path_rank, pos, id, piece, loss_start, loss_end), offsets inside the piece in code points."""
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    own = F.col("role").isin(*trained)
    return paths(messages, top).select(
        "tree", "leaf", "path_rank", "pos", "id", F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.when(own, F.length(head)).cast("long").alias("loss_start"),
        F.when(own, F.length(head) + F.length(body)).cast("long").alias("loss_end"),
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) as messages, each answering the one before; the score is the text's length."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    at = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", "role", "text", at.alias("at")).select(
        F.col("conv_id").alias("tree"), F.col("at").alias("id"), F.nullif(F.col("at") - 1, F.lit(0)).alias("parent"),
        "role", "text", F.length("text").alias("score"))


TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(text)]


def _digests(batches):
    """One row per conversation of pieces that come in order; holds one conversation's running hashes."""
    key, state = None, None

    def row():
        return (*key[:1], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    for b in batches:
        out = []
        spans = zip(b["tree"].astype(object), b["path_rank"], b["piece"], b["loss_start"], b["loss_end"], strict=True)
        for tree, rank, piece, start, end in spans:
            now = (None if pd.isna(tree) else int(tree), rank)
            if now != key:
                if key:
                    out.append(row())
                key, state = now, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            for role, text in read_turns(piece):
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
            if not pd.isna(start):
                text = unescape(piece[int(start):int(end)])
                state["loss"].update(text.encode())
                state["loss_chars"] += len(text)
            state["chars"] += len(piece)
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    if key:
        yield pd.DataFrame([row()], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(pieces: DataFrame) -> DataFrame:
    """What a reader finds in formatted conversations with whole-number ids: turns, and the text under the loss mask."""
    ordered = pieces.repartition("tree", "path_rank").sortWithinPartitions("tree", "path_rank", "pos")
    return ordered.select("tree", "path_rank", "piece", "loss_start", "loss_end").mapInPandas(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
