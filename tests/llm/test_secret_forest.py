"""Candidates against a plain scan, features on known cases, held-out accuracy of the forest."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tertulia.llm import secret_forest as S
from tertulia.llm.queries import QUERIES

from .helpers import EDGES, WORD, documents_of, save_tables


def plain_candidates(text):
    out = []
    for i, w in enumerate(WORD.findall(text or "")):
        if re.search(S.MIXED, w):
            out += [(i, c) for c in re.findall(r"[A-Za-z0-9+/_.-]{12,}", w) if re.search(S.MIXED, c)]
    return out


@pytest.mark.parametrize("where", ["tables", "edges"])
def test_query_finds_every_candidate(spark, sf_dir, tmp_path, where):
    more = [(50, 'x token = "a1b2c3d4e5f6a7b8c9d0" and aB1234567890;zz-998877665544 z'), (50, "10.20.30.40 1.2.3.4"), (None, "9" * 40)]
    folder = sf_dir if where == "tables" else save_tables(spark, tmp_path, EDGES + more)
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want.update((r.doc_id, *c) for c in plain_candidates(r.text))
    rows = QUERIES["op7_secret_forest"](spark, folder).collect()
    assert Counter((r.doc_id, r.word_index, r.candidate) for r in rows) == want
    assert all(r.is_secret == (r.score is None or r.score >= 0.5) for r in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = S.vocabulary(docs)
    rows = S.with_features(S.candidates(docs), words)
    examples = S.labelled(rows).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(2))).cache()
    model = S.train(examples.where("part = 0"))
    out = S.scored(examples.where("part = 1"), model).select("label", "is_secret").collect()
    right = sum((r.label == 1.0) == r.is_secret for r in out)
    assert len({r.label for r in out}) == 2 and right >= 0.95 * len(out)
    examples.unpersist()


def test_features(spark):
    df = documents_of(spark, [(1, 'my secret: "thehouse-thehouse99" here'), (2, "the house the house")] + [(i, "thehouse stands") for i in range(10, 16)])
    words = S.vocabulary(df)
    assert {r.word: r.n for r in words.collect()}["thehouse"] == 7
    r = S.with_features(S.candidates(df), words).first()
    assert (r.candidate, r.length, r.secret_before, r.assigned, r.quoted) == ("thehouse-thehouse99", 19.0, 1.0, 1.0, 1.0)
    assert abs(r.covered - 16 / 19) < 1e-9 and r.longest_digits == 2.0 and r.only_hex == 0.0
    assert -8 <= r.transitions < 0


def test_edges(spark):
    df = documents_of(spark, EDGES, extra=True)
    assert S.scan(df).count() == sum(len(plain_candidates(t)) for _, t in EDGES)
    assert S.scan(df.limit(0)).count() == 0
    one = documents_of(spark, [(1, "abc123abc123abc")])
    assert [(r.score, r.is_secret) for r in S.scan(one).collect()] == [(None, True)]


def test_no_python_on_the_executors(spark, sf_dir):
    plan = QUERIES["op7_secret_forest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_equal_findings_train_once(spark):
    """One finding in many rows must not fill the sample, whichever label it has."""
    rows = [(i, f'x token = "a1b2c3d4e5f6a7b8c9d{i:03d}" end') for i in range(20)]
    rows += [(100 + i, f"on 2024-01-02-{i:04d} it was") for i in range(20)]
    df = documents_of(spark, rows)
    found = S.labelled(S.with_features(S.candidates(df), S.vocabulary(df))).cache()
    assert {r.label for r in found.select("label").distinct().collect()} == {0.0, 1.0} and found.count() == 40
    least = found.orderBy(F.xxhash64("candidate", "word", "before", "before2", "after")).limit(1)
    copied = found.unionByName(least.crossJoin(spark.range(50)).drop("id"))
    model = S.train(copied, 20)
    assert model is not None
    assert all(r.is_secret == (r.label == 1.0) for r in S.scored(found, model).collect())
    found.unpersist()


def test_dictionary_counts_distinct_texts(spark):
    copies = [(10 + i, "quuxword stands here") for i in range(9)]
    df = documents_of(spark, [(1, "a thehouse-quuxword99 b"), (2, "thehouse is"), (3, "thehouse was"), *copies])
    words = {r.word: (r.n, r.distinct_n) for r in S.vocabulary(df).collect()}
    assert words["thehouse"] == (3, 3) and words["quuxword"] == (10, 2) and words["stands"] == (9, 1) and words[""] == (12, 4)
    # three of some 3000 distinct texts are too few, however often they are copied
    few = [(1, "a copiedword-copiedword99 b"), *[(10 + i, f"copiedword {'ab'[i % 2]}") for i in range(6)]]
    many = documents_of(spark, few + [(100 + i, f"text {i}") for i in range(3000)])
    assert S.with_features(S.candidates(many), S.vocabulary(many)).first().covered == 0.0
