"""SimHash near-duplicates, with pivot distance tables.

A text's 64-bit fingerprint has a bit set where over half of its shingles' hashes have it.  Only distinct
fingerprints are compared.  For each of them the Hamming distances to ``N_PIVOTS`` reference
fingerprints are computed once.  Pairs that could link meet in an equality join: three differing bits touch at most three of six
blocks of bits, so two linked fingerprints agree on some three blocks (20 choices, about 32 bits each).
Of the pairs that meet, those whose pivot distances differ by more than three anywhere are discarded (the
triangle inequality), and the exact distance verifies the rest.  Linked fingerprints form components.

Defined results: NULL text counts as empty; fewer words than a shingle give one shingle of them all; no
word gives fingerprint zero, linked like any other; equal texts and repeated rows share their fingerprint and
component; NULL ids take part and count as the largest id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tertulia.llm.common import checkpointed
from tertulia.llm.graph import components

WIDTH, SEED, MAX_BITS = 3, 42, 3
N_PIVOTS = 16
# Six blocks of 64 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIECE = 1 << 20


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of about ``PIECE`` bytes (``bytes.split`` knows exactly the blanks meant)."""
    start = 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[start:end].split()
        start = end


def _shingle_hashes(raw: bytes, width: int) -> Iterator[np.ndarray]:
    digest, kept, n = xxhash.xxh64_intdigest, [], 0
    for words in _words(raw):
        run = kept + words
        n += len(words)
        if len(run) >= width:
            joined = b" ".join(run)
            ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(run) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(run) - width + 1)
        kept = run[-(width - 1):] if width > 1 else []
    if 0 < n < width:
        yield np.array([digest(b" ".join(kept), SEED)], np.uint64)


def simhash(text: str | None, width: int = WIDTH) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes((text or "").encode().lower(), width):
        n += len(hashes)
        for i in range(0, len(hashes), 8192):
            part = hashes[i:i + 8192].byteswap().view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(x) for x in texts], dtype="int64")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _pivot_table(fp: Column) -> Column:
    """Hamming distances to the reference fingerprints, which are seeded random numbers."""
    pivots = np.random.default_rng(SEED).integers(-(1 << 63), (1 << 63) - 1, N_PIVOTS, np.int64)
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("tinyint") for p in pivots])


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints in column fp that differ in ``MAX_BITS`` bits or fewer."""
    masks = []
    for chosen in combinations(BLOCKS, len(BLOCKS) - MAX_BITS):
        mask = sum(((1 << n) - 1) << at for at, n in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = prints.select("fp", _pivot_table(F.col("fp")).alias("far"), F.posexplode(
        F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "bits"))
    a = keyed.select("k", "bits", F.col("fp").alias("u"), F.col("far").alias("far_u"))
    b = keyed.select("k", "bits", F.col("fp").alias("v"), F.col("far").alias("far_v"))
    apart = F.array_max(F.zip_with("far_u", "far_v", lambda x, y: F.abs(x - y)))
    met = a.join(b, ["k", "bits"]).where(F.col("u") < F.col("v")).where(apart <= MAX_BITS)
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v").distinct()


def classes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per distinct fingerprint of ``rows`` (key, fp): fp, root (of its component), component_id."""
    prints = checkpointed(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(prints.select("fp")))
    joined = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    return joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the smallest key reachable) of every row."""
    rows = checkpointed(docs.select(key, fingerprint(text).alias("fp")))
    return rows.join(classes(rows, key).select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the smallest key (NULL last), then the smallest fingerprint and text."""
    names = docs.columns
    # never NULL, and said so: the join below would else filter by the fingerprint first and compute it once more for that
    held = docs.select(F.struct(*names).alias("doc"), F.coalesce(fingerprint(text), F.lit(0)).alias("fp"))
    ids = checkpointed(held.select(F.col(f"doc.{key}").alias("id"), "fp"))
    owners = ids.join(classes(ids, "id").select("fp", "root"), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "fp")).alias("w"))
    owners = owners.select("w.none", "w.id", "w.fp")
    keyed = held.select("doc", F.col(f"doc.{key}").isNull().alias("none"), F.coalesce(f"doc.{key}", F.lit(0)).alias("id"), "fp")
    first = Window.partitionBy("none", "id", "fp").orderBy(*[F.col("doc")[c] for c in [text, *[n for n in names if n != text]]])
    return (
        keyed.join(owners, ["none", "id", "fp"]).withColumn("__n", F.row_number().over(first)).where("__n = 1").select("doc.*")
    )
