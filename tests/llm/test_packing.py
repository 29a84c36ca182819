"""Packing: exact ids, whole coverage, limits and padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tertulia.llm import vector_packing as V
from tertulia.llm.queries import QUERIES, tokenizer_path

from .helpers import EDGES, documents_of, save_tables, texts_of

ODD = [
    "", "a", "Don't stop. It's 3.14, isn't it?", "İstanbul ΣΑΣ Straße", "<|endoftext|> in <|startoftext|>x", "été été.",
    "a b c\x1cd\x85e", "tab\tand\x0bmore\x0c\r\n", "漢字かな交じり文 123", "👍🏽👍", "Élan, ÇA. va,. x.y", "ﬁ Ⅳ ½", "̀ leading mark ̀x",
]


def plain_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], np.uint32) for x in texts]


def test_encoder_equals_tokenizer(spark, sf_dir):
    texts = ODD + [t for t in texts_of(spark, sf_dir).values()][:80]
    found = V.Encoder(tokenizer_path())(texts)
    for text, ids, want in zip(texts, found, plain_ids(texts), strict=True):
        assert ids.tolist() == want[:-1].tolist(), text[:50]


def check_pieces(rows, ids, limits):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[key])
            part = ids[key][at:at + r.length].astype("<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids[key])
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
        total += at
    assert padding <= 0.01 * total
    return sequences


@pytest.mark.parametrize("where", ["tables", "edges"])
def test_query(spark, sf_dir, tmp_path, where):
    folder = sf_dir if where == "tables" else save_tables(spark, tmp_path, EDGES + [(100 + i, t) for i, t in enumerate(ODD)])
    texts = texts_of(spark, folder)
    ids = dict(zip(texts, plain_ids(texts.values()), strict=True))
    check_pieces(QUERIES["op3_vector_packing"](spark, folder).collect(), ids, V.Limits())


@pytest.mark.parametrize("limits", [V.Limits(64, 4, 20), V.Limits(64, 1, 64), V.Limits(8, 8, 1)])
def test_three_limits_at_once(limits):
    rng = random.Random(1)
    items = [(rng.randint(1, 150), rng.randint(0, 100)) for _ in range(300)]
    pool = V.Pool(limits)
    for i, (n, free) in enumerate(items):
        pool.add(i, 0, n, min(n, free))
    covered = defaultdict(list)
    while pool.examples:
        pieces = pool.sequence()
        assert pieces and len(pieces) <= limits.segments and sum(p[2] for p in pieces) <= limits.tokens
        loss = 0
        for i, start, n in pieces:
            covered[i].append((start, n))
            loss += max(0, start + n - max(start, min(items[i])))
        assert loss <= limits.loss_tokens
        for own in V.at_powers(pieces, limits.tokens):
            size = sum(p[2] for p in own)
            assert size & (size - 1) == 0
    for i, (n, _) in enumerate(items):
        at = 0
        for start, size in sorted(covered[i]):
            assert start == at
            at += size
        assert at == n
    assert pool.tokens == 0


def test_prompts_and_repeated_rows(spark):
    df = documents_of(spark, [(1, "answer one"), (1, "answer one"), (None, None), (2, "x " * 5000)], extra=True)
    rows = V.pack(df, tokenizer_path(), prompt="lang").collect()
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in plain_ids(["answer one"] * 2 + ["", "x " * 5000]))
    assert V.pack(df.limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        V.pack(df, tokenizer_path(), limits=V.Limits(0, 1, 1))
