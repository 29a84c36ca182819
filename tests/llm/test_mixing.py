"""Targets, rates and copies of the mix against a plain version."""

from collections import Counter, defaultdict

import pytest

from tertulia.llm import entropy_mixing as M
from tertulia.llm.queries import QUERIES

from .helpers import EDGES, WORD, documents_of, save_tables


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not above:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    return target


@pytest.mark.parametrize("where", ["tables", "edges"])
def test_query(spark, sf_dir, tmp_path, where):
    if where == "tables":
        folder = sf_dir
    else:
        rows = EDGES + [(5, "one"), (20, "a b c"), (21, "d e")]
        df = documents_of(spark, rows).selectExpr("doc_id", "text", "lang", "if(doc_id > 9, null, source) source", "n_chars")
        df.write.parquet(f"{tmp_path}/documents.parquet")
        folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in docs:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    want = plain_targets(sizes)
    rows = QUERIES["op6_entropy_mixing"](spark, folder).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs)
    by_source = {r.doc_id: r.source for r in docs}
    taken = Counter()
    for r in rows:
        s = by_source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r["size"] and 0 <= r.rate <= 2
        taken[s] += r.taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(0.02 * goal, longest[s] if where == "edges" else 120), (s, taken[s], goal)
    again = QUERIES["op6_entropy_mixing"](spark, folder).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_rates_meet_the_constraints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = M.with_copies(docs).collect()
    got, goal = defaultdict(float), {}
    for r in rows:
        got[r.source] += r.rate * r["size"]
        goal[r.source] = r.target
    assert all(abs(got[s] - goal[s]) <= 1e-4 * goal[s] for s in goal)


def test_mix_repeats_documents(spark):
    rows = [(i, "word " * (1 + i % 7)) for i in range(60)] + [(None, None), (1, "word word "), (1, "word word ")]
    df = documents_of(spark, rows, extra=True)
    out = M.mix(df)
    assert out.columns == df.columns
    counts = Counter((r.doc_id, r.text) for r in out.collect())
    copies = Counter()
    for r in M.with_copies(df).collect():
        copies[(r.doc_id, r.text)] += r.copies
    assert counts == +copies
    assert M.mix(df.limit(0)).count() == 0 and M.with_copies(df.where("text is null")).count() == 1
