"""Repeats against brute force over all strings of fifty bytes; the run-length index against plain search."""

import hashlib
import random

import numpy as np
import pytest

from tertulia.llm import suffix_dedup as D
from tertulia.llm.queries import QUERIES
from tertulia.llm.run_index import RunIndex

from .helpers import EDGES, documents_of, save_tables


def plain(rows):
    big = 1 << 63
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k:k + 50]
            least[w] = min(least.get(w, big), big - 1 if i is None else i)
    out = []
    for i, text in rows:
        raw, me = (text or "").encode(), big - 1 if i is None else i
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            if least[raw[k:k + 50]] < me:
                gone[k:k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(6, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        text = " ".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages), parts[2]])
        rows.append((i * 3, text))
    for i in range(12):  # near copies
        base = rng.choice(rows)[1]
        at = rng.randrange(len(base))
        rows.append((1 + 3 * i, base[:at] + "#" + base[at + rng.randint(0, 3):]))
    rows += [(5, "ab" * 400), (8, "ab" * 300 + "c"), (11, "c" + "ba" * 70), (14, rows[0][1]), (2, rows[3][1]), (2, rows[4][1])]
    return rows + [(500 + i, t) for i, t in EDGES if i != 9] + [(None, rows[7][1]), (None, "x" * 60), (500, "x" * 60), (7, rows[8][1]), (7, rows[8][1])]


@pytest.mark.parametrize("where", ["tables", "made", "small chunks"])
def test_query(spark, sf_dir, tmp_path, where, monkeypatch):
    if where == "small chunks":
        monkeypatch.setattr(D, "ANCHOR_BYTES", 3000)
        monkeypatch.setattr(D, "SEGMENT_BYTES", 1000)
        monkeypatch.setattr(D, "GROUP_BYTES", 2000)
    folder = sf_dir if where == "tables" else save_tables(spark, tmp_path, made_rows())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, folder).collect()), key=repr)
    want = plain(rows)
    assert found == want
    assert sum(r[2] for r in want) > 1000


def test_long_texts_are_cut_into_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(D, "CHUNK", 120)
    texts = ["abc" * 200, "x" * 49, "", "y" * 50, "z" * 121]
    seen = {i: [] for i in range(5)}
    for buf, rows, froms, starts, sizes in D._chunks(pa.array(texts)):
        for r, f, a, n in zip(rows, froms, starts, sizes, strict=True):
            assert bytes(buf[a:a + n]).decode() == texts[r][f:f + n]
            seen[int(r)] += range(f, f + n - 49)
    assert {i: len(x) for i, x in seen.items()} == {i: max(0, len(t) - 49) for i, t in enumerate(texts)}
    assert all(len(x) == len(set(x)) for x in seen.values())


def test_run_index_finds_least_text():
    rng = np.random.default_rng(1)
    sizes = rng.integers(50, 77, 300)
    base = rng.integers(97, 100, 400, dtype=np.uint8)
    rows = np.zeros((300, 76), np.uint8)
    for i, n in enumerate(sizes):
        a = rng.integers(0, 300)
        rows[i, :n] = base[a:a + n]
        rows[i, rng.integers(0, n)] = 120
    rows, at = np.unique(rows, axis=0, return_index=True)
    sizes = sizes[at]
    weight = rng.integers(0, 50, len(rows))
    index = RunIndex(rows, sizes, 50)
    assert len(index.starts) < len(index.text)
    least = {}
    for r, n, w in zip(rows, sizes, weight, strict=True):
        for k in range(n - 49):
            b = bytes(r[k:k + 50])
            least[b] = min(least.get(b, 99), w)
    count = 0
    for texts, pos, low in index.stream(weight):
        for t, k, x in zip(texts, pos, low, strict=True):
            assert least[bytes(rows[t, k:k + 50])] == x
            count += 1
    assert count == int((sizes - 49).sum())


def test_edges(spark):
    df = documents_of(spark, [(1, "q" * 80)], extra=True)
    assert D.remove_repeats(df.limit(0)).count() == 0
    row = D.remove_repeats(df.union(df.selectExpr("doc_id + 1", "text", *df.columns[2:]))).where("doc_id = 2").first()
    assert (row.n_removed, row.n_spans, row.spans) == (80, 1, [0, 80])
