"""The manifest against a plain tree."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tertulia.llm import merkle_manifest as M
from tertulia.llm.queries import ORACLE, op12_merkle_manifest

from .helpers import EDGES, documents_of

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def plain_levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        start = i - i % 3
        path.append(("".join(level[start:i]), "".join(level[i + 1:start + 3])))
        i //= 3
    return path


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id, plain_leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = plain_levels([x[2] for x in groups[s]])
    top = plain_levels([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, (_, doc_id, leaf, r) in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(top, n)
            changed = doc_id is not None and r.text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = plain_leaf(r, r.text.replace("\n", "")) if changed else leaf
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r[n] for n in NAMES)) for r in df.collect())


def test_query_and_its_sql(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = plain_manifest(rows)
    assert found(op12_merkle_manifest(spark, sf_dir)) == expected
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    same = con.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLE['op12_merkle_manifest']})").fetchall()
    assert sorted(map(repr, same)) == expected
    assert {r.endswith("True)") for r in expected} == {True, False}


def test_large_source_and_many_sources(spark, tmp_path):
    """More rows than a block of blocks needs, and sources of 1 to 40 rows."""
    rows = spark.range(2300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("line\n"), F.col("id")).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 1500, "big").when(F.col("id") < 2290, F.concat(F.lit("s"), F.floor(F.sqrt(F.col("id") - 1500)))).alias("source"),
        F.length("text").cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    plain = plain_manifest(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert found(op12_merkle_manifest(spark, str(tmp_path))) == plain


@pytest.mark.parametrize("levels", [1, 2])
def test_small_blocks(spark, tmp_path, monkeypatch, levels):
    """Roots recurse through several rounds of blocks."""
    monkeypatch.setattr(M, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3 ** levels)
    documents_of(spark, [(i, f"t{i}\n") for i in range(100)]).write.parquet(f"{tmp_path}/documents.parquet")
    plain = plain_manifest(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert found(op12_merkle_manifest(spark, str(tmp_path))) == plain


@pytest.mark.parametrize("rows", [[*EDGES, (None, None), (None, "x"), (3, "again\n"), (3, "again\n")], [(7, "a\nb")], []])
def test_edges(spark, tmp_path, rows):
    docs = documents_of(spark, rows).withColumn("source", F.when(F.col("doc_id") > 2, F.col("source")))
    docs.selectExpr("*", "'x' AS grp", "'y' AS leaf", "1 AS idx", "'z' AS hash", "0 AS total").write.parquet(f"{tmp_path}/documents.parquet")
    plain = plain_manifest(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert found(op12_merkle_manifest(spark, str(tmp_path))) == plain


def test_other_columns_travel(spark):
    leaves = documents_of(spark, [(1, "a"), (2, "b")]).select(
        "doc_id", "source", F.lit("other").alias("hash"), F.lit(5).alias("idx"), M.leaf_hash([F.col("text")]).alias("leaf"))
    rows = M.manifest(leaves).collect()
    assert {(r.hash, r.idx) for r in rows} == {("other", 5)}
    checked = M.manifest(leaves).where(M.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    assert checked.count() == 2
