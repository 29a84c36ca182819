"""Sharding by a two-pass external shuffle.

Pass one scatters records: the shard follows from the key alone (highest seeded hash over all shards, so
that one more shard takes records only into itself), and inside its shard a record goes to a bucket by a
seeded hash of its whole content.  The number of buckets follows from the bytes, so that each fits in
memory.  Pass two brings a bucket's records into a fixed order, permutes them by Fisher-Yates (the built-in
``shuffle``) and numbers them; a small table of bucket counts gives each bucket its first slot.

The records are shuffled once.  Bucket numbers and the order before the permutation depend on the rows
only, and the number of partitions is fixed before the shuffle, so a task that runs again gives the same rows.

Defined results: NULL keys form one key; repeated keys share a shard but spread over its buckets, and
identical rows are kept, each in a slot of its own; records larger than a bucket are allowed; an empty table gives an empty
table; input columns named shard, bucket, slot or grown_shard are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEED = 20240


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """Shard of a key among ``n_shards``, and among one more."""
    weight = lambda s: F.xxhash64(F.lit(seed), key, s)
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(weight(s).alias("w"), s.alias("s"))
    ))
    return best["s"], F.when(weight(F.lit(n_shards)) > best["w"], F.lit(n_shards)).otherwise(best["s"])


def shuffle_into_shards(
    df: DataFrame, n_shards: int, key: str, size: Column, bucket_bytes: int = 24 << 20, seed: int = SEED
) -> DataFrame:
    """All records with ``shard``, ``grown_shard`` (with one more shard), ``bucket`` and ``slot`` in the shard.

    ``size`` is a record's size in bytes; ``bucket_bytes`` is what a task holds in memory at once.
    """
    names = [c for c in df.columns if c not in ("shard", "grown_shard", "bucket", "slot")]
    total = df.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-int(total) // (n_shards * bucket_bytes)))
    shard, grown = shard_of(F.col(key), n_shards, seed)
    content = F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in names])
    placed = df.select(
        *names, shard.alias("shard"), grown.alias("grown_shard"), content.alias("__order")
    ).withColumn("bucket", F.col("shard").cast("long") * per_shard + F.pmod("__order", F.lit(per_shard)))

    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))

    record = F.struct("__order", *names, "grown_shard")
    buckets = placed.repartition(n_shards * per_shard, "bucket").groupBy("bucket", "shard").agg(
        F.sort_array(F.collect_list(record)).alias("__records")
    )
    mixed = buckets.join(first, "bucket").sortWithinPartitions("bucket").select(
        "shard", "bucket", "__first", F.posexplode(F.shuffle("__records", F.lit(seed))).alias("__at", "__record")
    )
    return mixed.select(
        *[F.col("__record")[c].alias(c) for c in names], "shard", F.col("__record.grown_shard").alias("grown_shard"),
        "bucket", (F.col("__first") + F.col("__at")).alias("slot"),
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a file stand in slot order."""
    shards.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
