"""Merkle manifest of a dataset: a hash tree over each source's rows and one over the sources.

A row is a leaf: H (lowercase hex SHA-256) of its fields.  In a source the leaves stand in order of their key, and every
``ARITY`` neighbours become their H until one node, the subroot, is left; the subroots in order of the sources make the
root likewise.  Nodes are kept as concatenated level strings: an aligned block of ``BLOCK`` neighbours holds each of its
levels as one string of 64 hex digits a node, so a parent is H of a substring of fixed width, and the two substrings
beside a node in its run are its sibling segments.  What is left of the blocks is the next, ``BLOCK`` times smaller,
input of the same step.

Work is spread by range: rows are sorted by (source, key) once, places follow from counts per partition, and no source,
however large, is sorted or collected in one task.  A group is a block of ``BLOCK`` rows at most.  Rows move as keys and
hashes; texts never.

Defined results: a NULL field is hashed as ``-``, so NULL and empty text differ; NULL keys come first in their source, the
NULL source first of all; equal keys are ordered by their hashes, equal rows are leaves of their own; one row alone is its own
subroot, one source's subroot the root; an empty table gives an empty manifest; columns that are not named are neither
hashed nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.llm.common import checkpointed
from tertulia.operators.ranking import running_offsets

ARITY, HEX, BLOCK_LEVELS = 3, 64, 6
BLOCK = ARITY ** BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H of the fields, each as its UTF-8 byte count, a colon and its value, or ``-``."""
    def told(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[told(f) for f in fields]), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``idx``, the place inside ``grp`` by ``order`` from 0, and ``total``, the rows of ``grp``."""
    rows = checkpointed(checkpointed(rows).repartitionByRange("grp", *order).sortWithinPartitions("grp", *order))
    rows = rows.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    runs = rows.groupBy("grp", "__pid").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    runs = running_offsets(runs, ["grp"], ["__pid"], "__n", "__before")
    runs = runs.withColumn("total", F.sum("__n").over(Window.partitionBy("grp")))
    placed = rows.join(runs.drop("__n"), ["grp", "__pid"])
    return placed.withColumn("idx", F.col("__before") + F.col("__at") - F.col("__first")).drop("__pid", "__at", "__first", "__before")


def _slice(level: Column, node: Column, n: Column | int) -> Column:
    """``n`` nodes of a level from a node on, fewer at its end."""
    return F.substring(level, (node * HEX + 1).cast("int"), (F.lit(n) * HEX).cast("int"))


def _parents(level: Column) -> Column:
    runs = F.ceil(F.octet_length(level) / (ARITY * HEX)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(_slice(level, i * ARITY, ARITY), 256))
    return F.array_join(hashed, "").cast("binary")


def _levels(first: Column, whole: Column) -> Column:
    """All levels of a block, from its lowest; ``whole`` blocks are parts of a larger tree and climb all the way."""
    def climb(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(whole | (F.octet_length(last) > HEX), F.concat(levels, F.array(_parents(last)))).otherwise(levels)
    return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), F.array(first), climb)


def _segments(levels: Column, place: Column) -> Column:
    """The siblings to the left and right of the node at ``place``, level by level."""
    width = F.array(*[F.lit(ARITY ** i) for i in range(BLOCK_LEVELS + 1)])

    def beside(level: Column, i: Column) -> Column:
        node = F.floor(place / F.get(width, i)).cast("int")
        rank = node % ARITY
        return F.struct(
            _slice(level, node - rank, rank).cast("string").alias("left"),
            _slice(level, node + 1, F.lit(ARITY - 1) - rank).cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, idx, total, hash, kept) as blocks: their nodes and levels, ``top`` (the last node of the group) and
    ``above``, the siblings of the block's own last node."""
    blocks = nodes.groupBy("grp", F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "hash", "kept"))).alias("nodes"), F.max("total").alias("total"))
    first = F.array_join("nodes.hash", "").cast("binary")
    blocks = checkpointed(blocks.withColumn("levels", _levels(first, F.col("total") > BLOCK)))
    last = F.element_at("levels", -1).cast("string")
    parts = blocks.where(F.col("total") > BLOCK)
    if parts.isEmpty():
        return blocks.withColumn("top", last).withColumn("above", _no_path())
    upper = _each(_blocks(parts.select(
        "grp", F.col("block").alias("idx"), F.ceil(F.col("total") / BLOCK).alias("total"), last.alias("hash"), F.lit(None).cast("string").alias("kept"))))
    upper = upper.select("grp", F.col("idx").alias("block"), F.col("top").alias("__top"), F.col("path").alias("__above"))
    return blocks.join(upper, ["grp", "block"], "left").withColumn("top", F.coalesce("__top", last)).withColumn(
        "above", F.coalesce("__above", _no_path()))


def _each(blocks: DataFrame, *more: str) -> DataFrame:
    """One row per node of the blocks: grp, top, idx, hash, kept, path and the columns ``more``."""
    # Paths are cut inside the block's row, so that its strings are not copied to every node.
    each = F.transform("nodes", lambda n, i: F.struct(
        n["idx"].alias("idx"), n["hash"].alias("hash"), n["kept"].alias("kept"),
        F.concat(_segments(F.col("levels"), i), F.col("above")).alias("path")))
    return blocks.select("grp", "top", *more, F.explode(each).alias("n")).select("grp", "top", *more, "n.*")


def manifest(leaves: DataFrame, key: str = "doc_id", source: str = "source", leaf: str = "leaf") -> DataFrame:
    """Per row of ``leaves``: all its columns, subroot, root and path, the siblings (left, right) from its leaf up to the root.

    ``leaf`` names the rows' hashes (``leaf_hash``).  The columns travel with the rows: hand in narrow ones.
    """
    names = leaves.columns
    # A prefix keeps the NULL source apart from every text, and in front of it.
    group = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = leaves.select(
        group.alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("hash"), F.struct(*names).alias("kept"))
    blocks = _blocks(_numbered(rows, ["key", "hash"]))
    tops = blocks.where(F.col("block") == 0).select(F.lit("").alias("grp"), F.col("grp").alias("kept"), F.col("top").alias("hash"))
    sources = _each(_blocks(_numbered(tops, ["kept"]))).select(
        F.col("kept").alias("grp"), F.col("top").alias("root"), F.col("path").alias("__path"))
    joined = blocks.join(sources, "grp").withColumn("above", F.concat("above", "__path"))
    return _each(joined, "root").select("kept.*", F.col("top").alias("subroot"), "root", "path")


def proof_hash(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give: equal to the root exactly where the leaf is the one hashed."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
