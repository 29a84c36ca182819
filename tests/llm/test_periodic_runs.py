"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from tertulia.llm import periodic_runs
from tertulia.llm.queries import op13_periodic_runs
from tertulia.llm.run_grammar import Grammar

from .helpers import EDGES, WORD, documents_of, save_tables, texts_of


def plain_runs(words):
    """Every maximal stretch by each period from the smallest on; a stretch counts once."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(6, 4 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else old[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n_words, q in runs for i in range(s + q, s + n_words)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, runs and 1000 * top[1] // top[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(rows):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted(map(repr, (tuple(r[n] for n in names) for r in rows)))


@pytest.mark.parametrize("seed", range(6))
def test_extensions_against_plain(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 + seed, 40)
    text = np.concatenate([base, base, np.zeros(rng.integers(1, 60), np.int64), np.tile(base[:7], 9), rng.integers(0, 3, 50)])
    text = np.append(text, 99)
    grammar = Grammar(text)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(text) - 1), np.arange(len(text) - 1)))
    a, b = a[a < b], b[a < b]
    after, before = grammar.extensions(a, b), grammar.extensions(a, b, forward=False)
    for i, j, x, y in zip(a, b, after, before, strict=True):
        m = 0
        while j + m < len(text) and text[i + m] == text[j + m]:
            m += 1
        assert x == m
        m = 0
        while i - m > 0 and text[i - m - 1] == text[j - m - 1]:
            m += 1
        assert y == m
    assert len(grammar.symbols[-1]) < len(text) / 4


@pytest.mark.parametrize("places", [7, 1 << 19])
def test_runs_against_plain(monkeypatch, places):
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", places)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, k, n) for k in (1, 2, 3, 9) for n in (0, 1, 5, 6, 7, 30, 130)]
    texts += [np.tile(rng.integers(0, 5, p), 6)[: 5 * p + 3] for p in (1, 2, 3, 4, 9, 17)]
    texts += [np.concatenate([rng.integers(0, 2, 9), np.tile([0, 1, 0, 1, 2], 7), np.zeros(30, np.int64)])]
    for text, runs in zip(texts, periodic_runs.runs_of(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(text.tolist())


def test_query(spark, sf_dir):
    expected = found_plain = sorted(repr(plain_row(i, t)) for i, t in texts_of(spark, sf_dir).items())
    assert found(op13_periodic_runs(spark, sf_dir).collect()) == expected
    assert sum(", None, None," not in r for r in found_plain) > 3


def test_edges(spark, tmp_path):
    rows = [*EDGES, (None, "a b " * 30), (3, "again"), (3, "again"), (40, "x y " * 9 + "z " * 4 + "x y z " * 8)]
    rows += [(100 + i, " ".join(f"w{j % (i + 1)}" for j in range(50))) for i in range(40)]
    save_tables(spark, tmp_path, rows)
    got = op13_periodic_runs(spark, str(tmp_path))
    assert found(got.collect()) == sorted(repr(plain_row(i, t)) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)


def test_empty_table_and_clashing_columns(spark):
    empty = periodic_runs.find_runs(documents_of(spark, []))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0
    docs = documents_of(spark, [(1, "a a a a a a a b")]).selectExpr("*", "'x' AS runs", "'y' AS key", "1 AS n_words")
    row = periodic_runs.find_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 7, 1)] and row.collapsed == "a b" and row.n_words == 8


def test_string_keys(spark):
    docs = spark.createDataFrame([("k", "a b " * 4)], "name string, body string")
    row = periodic_runs.find_runs(docs, "name", "body").first()
    assert (row["name"], [tuple(r) for r in row.runs]) == ("k", [(0, 8, 2)])
