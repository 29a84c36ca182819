"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tertulia.llm import simhash_pivots as S
from tertulia.llm.graph import components
from tertulia.llm.queries import QUERIES

from .helpers import EDGES, documents_of, python_nodes, save_tables, texts_of


def plain_simhash(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("where", ["tables", "edges"])
def test_query_equals_brute_force(spark, sf_dir, tmp_path, where):
    folder = sf_dir if where == "tables" else save_tables(spark, tmp_path, EDGES)
    texts = texts_of(spark, folder)
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    want = plain_components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_pivots"](spark, folder).collect()}
    assert found == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 7)
    text = "Aa b\tccc dd\x0be \x1cf ggggggggggggggggggg h  i\nj é" * 20
    assert S.simhash(text) % (1 << 64) == plain_simhash(text)


def test_links_are_complete(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(200)]
    for p in list(prints):
        q = p
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            q ^= 1 << b
        prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in sorted(set(signed))], "fp long")
    found = {(r.u, r.v) for r in S.links(df).collect()}
    x = np.array(sorted(set(signed)), np.int64)
    want = {(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1:] if int(a ^ b).__and__((1 << 64) - 1).bit_count() <= 3}
    assert found == want and len(want) > 100


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    rows = [*EDGES, (5, "one"), (3, "x y z w"), (3, "p q r s"), (None, "one"), (None, "only here stands this")]
    df = documents_of(spark, rows, extra=True)
    out = S.keep_one(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert [k for k in kept if k[1] == "one"] == [(4, "one")]
    assert (None, "only here stands this") in kept and (3, "x y z w") in kept and (3, "p q r s") in kept
    assert len([k for k in kept if not (k[1] or "").strip()]) == 1
    assert S.keep_one(df.limit(0)).count() == 0 and S.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_computes_a_fingerprint_once_in_a_task(spark):
    """The join's test for NULL keys does not compute it a second time, in a second worker."""
    assert python_nodes(S.keep_one(documents_of(spark, EDGES))) == ["fingerprint"]
