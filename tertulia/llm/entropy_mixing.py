"""Mixing sources to target weights by entropy balancing.

Each source shall give a target number of words.  Document rates come from the convex dual: among all rates
between 0 and ``MAX_COPIES`` that meet the token constraints they are the ones of greatest entropy, an
exponential tilt in the document's size, bounded by the copies allowed,

    rate = MAX_COPIES / (1 + exp(-lambda_source * size / mean size of the source)).

The multipliers are found by Newton steps, one aggregation over (source, size) counts each, for all sources at once
and kept inside a shrinking bracket.  Sources at their limit have the rate ``MAX_COPIES``.  Rates are
rounded into whole copies: per source, from large to small sizes, the words still owed are carried on, so that
the total misses its target by less than a short document, and single copies are exchanged to close the rest; within documents of one size the copies
go to the smallest seeded hashes.

No task holds more than the distinct sizes of a source or a 64th of the documents of one size and source.
The table of sources is ranked in one task: one row per source.

Defined results: NULL text has size 0; NULL source is a source, last in order; documents of size 0 are kept once;
repeated rows are separate documents; an empty table gives an empty table; input columns named like a
result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tertulia.llm.common import checkpointed, text_of, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = 71
SALTS = 64
SETTLE_STEPS = 20
STEPS, TOLERANCE, REACH = 60, 1e-6, 1e4


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, n_docs, source_size and target, from rows of (source, size, n).

    Weights repeat over the sources in code-point order (NULL last) and share ``share`` of all words; a target above
    ``MAX_COPIES`` times its source's size stops there and the excess is shared again.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MAX_COPIES)
    every = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(share)
    # from the source that is full first: what is left, shared among those not yet full
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = ranked.withColumn("budget", budget).withColumn("full", F.col("cap") <= F.col("weight") * level)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    share_of_rest = F.col("weight") * (F.col("budget") - taken) / open_weight
    return full.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(share_of_rest)).select(
        "source", "n_docs", "source_size", "target", "full")


def _sigma(x):
    return 1 / (1 + F.exp(-x))


def multipliers(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """Newton's method on the dual: ``goals`` (source, n_docs, source_size, target, full) with its multiplier ``lam``.

    Only sources below their limit take part; one aggregation over ``cells`` (source, size, n) a step.
    """
    open_goals = goals.where(~F.col("full")).withColumn("mean", F.col("source_size") / F.col("n_docs"))
    state = checkpointed(open_goals.select(
        "source", "mean", "target", (F.col("source_size") * F.lit(float(MAX_COPIES))).alias("cap"), F.lit(0.0).alias("lam"), F.lit(-REACH).alias("lo"), F.lit(REACH).alias("hi"), F.lit(1.0).alias("miss")))
    for _ in range(STEPS):
        x = F.col("c.size") / F.col("s.mean")
        rate = _sigma(F.col("lam") * x)
        words = F.col("c.n") * F.col("c.size") * MAX_COPIES
        sums = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(
            F.col("s.source").alias("source"), "mean", "target", "cap", "lam", "lo", "hi"
        ).agg(F.sum(words * rate).alias("got"), F.sum(words * x * rate * (1 - rate)).alias("slope"))
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        # a Newton step on the logarithm of what is taken or, above the source's size, of what is still left out
        room, want = F.col("cap") - F.col("got"), F.col("cap") - F.col("target")
        gap = F.when(F.col("target") * MAX_COPIES > F.col("cap"), F.log(room / want) * room).otherwise(
            -F.log(F.col("got") / F.col("target")) * F.col("got"))
        newton = F.col("lam") + gap / F.nullif("slope", F.lit(0.0))
        moved = sums.withColumn("miss", F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0)))
        moved = moved.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("next", newton)
        inside = (F.col("next") > F.col("lo2")) & (F.col("next") < F.col("hi2"))
        step = F.when(F.col("miss") <= TOLERANCE, F.col("lam")).when(inside, F.col("next")).otherwise(
            (F.col("lo2") + F.col("hi2")) / 2)
        state = checkpointed(moved.select(
            "source", "mean", "target", "cap", step.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "miss"))
        if (state.agg(F.max("miss")).first()[0] or 0) <= TOLERANCE:
            break
    return state.select("source", "mean", "lam")


def _settle(size: np.ndarray, most: np.ndarray, copies: np.ndarray, owed: float) -> None:
    """Change single copies, one more here and one less there, while that brings the words owed nearer to zero."""
    for _ in range(SETTLE_STEPS):
        more, less = np.flatnonzero((copies < most) & (size > 0)), np.flatnonzero((copies > 0) & (size > 0))
        add = np.concatenate(([0], size[more][::-1]))  # ascending, as cells run from large to small
        cut = np.concatenate(([0], size[less]))
        near = np.searchsorted(add, owed + cut)
        gaps = [np.abs(owed + cut - add[np.clip(near + d, 0, len(add) - 1)]) for d in (-1, 0)]
        pick = int(np.argmin(np.minimum(*gaps)))
        d = int(gaps[1][pick] < gaps[0][pick]) - 1
        k = int(np.clip(near[pick] + d, 0, len(add) - 1))
        if abs(owed + cut[pick] - add[k]) >= abs(owed) - 0.5:
            return
        owed += cut[pick] - add[k]
        if k:
            copies[more[::-1][k - 1]] += 1
        if pick:
            copies[less[pick - 1]] -= 1


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one source's cells; words owed are carried from large sizes to small ones."""
    cells = cells.sort_values("size", ascending=False)
    size, n, rate = (cells[c].to_numpy() for c in ("size", "n", "rate"))
    owed, copies = 0.0, (np.floor(rate) * n).astype(np.int64)
    for i, part in enumerate((rate - np.floor(rate)) * n):
        if size[i]:
            owed += part * size[i]
            extra = min(n[i], max(0, int(owed / size[i] + 0.5)))
            copies[i] += extra
            owed -= extra * size[i]
    _settle(size, MAX_COPIES * n, copies, owed)
    return cells.assign(base=copies // n, extra=copies % n)[["source", "size", "rate", "base", "extra"]]


def with_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE,
) -> DataFrame:
    """The documents with size, source_size, target, rate and ``copies`` (0 to ``MAX_COPIES``)."""
    results = ("size", "source_size", "target", "rate", "copies")
    names = [c for c in docs.columns if c not in results]
    size = F.size(words_of(text_of(text))).cast("long")
    order = F.xxhash64(F.lit(SEED), F.col(key), text_of(text))
    sized = docs.select(*names, size.alias("size"), order.alias("__h")).withColumn(
        "__salt", F.pmod("__h", F.lit(SALTS)).cast("int"))
    groups = checkpointed(sized.groupBy(F.col(source).alias("source"), "size", "__salt").agg(F.count("*").alias("n")))
    cells = checkpointed(groups.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goals = checkpointed(targets(cells, weights, share))
    lams = multipliers(cells, goals)

    rated = cells.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).join(
        lams.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left")
    rate = F.when(F.col("c.size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(MAX_COPIES))).otherwise(
        MAX_COPIES * _sigma(F.col("lam") * F.col("c.size") / F.col("mean")))
    rated = rated.select("c.source", "c.size", "c.n", rate.alias("rate"), "source_size", "g.target")
    whole = rated.groupBy("source").applyInPandas(_round, "source string, size long, rate double, base long, extra long")
    cell = ["source", "size"]
    cells2 = checkpointed(rated.drop("rate").alias("a").join(
        whole.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    ).select("a.*", "b.rate", "b.base", "b.extra"))
    # a cell's extra copies over its salts, in proportion and exactly
    before = Window.partitionBy(*cell).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = groups.alias("p").join(
        cells2.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.size") == F.col("c.size"))
    ).select("p.source", "p.size", "__salt", F.col("p.n").alias("part"), F.col("c.n").alias("n"), "rate", "base", "extra", "source_size", "target")
    start = F.coalesce(F.sum("part").over(before), F.lit(0))
    cut = lambda x: F.floor(x * F.col("extra") / F.col("n"))
    shares = shares.withColumn("__extra", cut(start + F.col("part")) - cut(start))
    own = sized.withColumn("__source", F.col(source)).alias("d").join(
        shares.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__salt").alias("__b"),
                      "rate", F.col("base").alias("__base"), "__extra", "source_size", "target").alias("t"),
        F.col("d.__source").eqNullSafe(F.col("t.__s")) & (F.col("d.size") == F.col("t.__z")) & (F.col("d.__salt") == F.col("t.__b")),
    )
    rank = F.row_number().over(Window.partitionBy("__source", "size", "__salt").orderBy("__h"))
    copies = F.col("__base") + (F.col("__rank") <= F.col("__extra")).cast("long")
    return own.withColumn("__rank", rank).withColumn("copies", copies.cast("long")).select(*names, *results)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as it has copies; same columns as the input."""
    names = docs.columns
    keys = {c: options.get(c, d) for c, d in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    inner = docs.select(F.struct(*names).alias("__doc"), *[F.col(c).alias(f"__{k}") for k, c in keys.items()])
    rated = with_copies(inner, **{**options, **{k: f"__{k}" for k in keys}})
    return rated.where("copies > 0").select("__doc", F.explode(F.expr("sequence(1, copies)"))).select("__doc.*")
