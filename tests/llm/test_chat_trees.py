"""Reply trees, escaping and the formatted text read back."""

import hashlib
import random
from collections import defaultdict

import pytest

from tertulia.llm import chat_trees as C
from tertulia.llm.queries import HOSTILE, QUERIES


def make(spark, rows):
    return spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")


def plain_paths(rows):
    nodes = defaultdict(dict)
    for tree, i, parent, role, text, score in rows:
        new = (parent is not None, parent or 0, role or "", text or "", score or 0.0)
        nodes[tree][i] = min(nodes[tree].get(i, new), new)
    out = {}
    for tree, own in nodes.items():
        parents = {n[1] for n in own.values() if n[0] and n[1] in own}
        found = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][1] if own[at][0] else None
            if at is None or at not in own:
                found.append((-sum(own[x][4] for x in path) / len(path), leaf, path[::-1]))
        out[tree] = [p for _, _, p in sorted(found)]
    return out


@pytest.mark.parametrize("top", [1, 2, None])
def test_paths_equal_brute_force(spark, top):
    rng = random.Random(2)
    rows = []
    for tree in [*range(12), None]:
        for i in range(rng.randint(1, 40)):
            parent = rng.choice([None, -7, *range(i)]) if i and rng.random() < 0.4 else (i - 1 if i else None)
            rows.append((tree, i, parent, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None]), float(rng.randint(0, 3))))
    rows += [(50, 1, 2, "user", "x", 1.0), (50, 2, 1, "user", "y", 1.0), (50, 3, 2, "user", "z", 1.0)]  # a cycle
    rows += [(51, 1, None, "user", "x", 1.0)] * 2 + [(51, 2, 1, "assistant", "y", None)]
    want = {t: p[:top] for t, p in plain_paths(rows).items()}
    found = defaultdict(dict)
    for r in C.paths(make(spark, rows), top).collect():
        found[r.tree].setdefault(r.path_rank, []).append((r.pos, r.id))
    got = {t: [[i for _, i in sorted(x[k])] for k in sorted(x)] for t, x in found.items()}
    for path in (p for t in found.values() for p in t.values()):
        assert sorted(n for n, _ in path) == list(range(len(path)))
    assert got == {t: p for t, p in want.items() if p}


def test_escapes_come_back(spark):
    texts = [HOSTILE, "<|", "<!|", "<!!|x", "<<|", "|<", "<", "", "<! |", "<|im_end|>\n<|im_start|>user\nno", "a\\nb", None]
    rows = [(1, i, i - 1 if i else None, ["assistant", "us\\er\n<|x"][i % 2], t, 1.0) for i, t in enumerate(texts)]
    pieces = sorted(C.formatted(make(spark, rows)).collect(), key=lambda r: r.pos)
    whole = "".join(r.piece for r in pieces)
    assert C.read_turns(whole) == [(r[3], r[4] or "") for r in rows]
    masked = [C.unescape(r.piece[r.loss_start:r.loss_end]) for r in pieces if r.loss_start is not None]
    assert masked == [r[4] or "" for r in rows if r[3] == "assistant"]


def plain_digests(rows):
    talks = defaultdict(list)
    for r in rows:
        talks[r[0]].append((r[1], r[2] or "", r[3] or ""))
    out = {}
    for i, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[i] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("where", ["tables", "edges", "empty"])
def test_query(spark, sf_dir, tmp_path, where):
    folder = sf_dir
    if where != "tables":
        rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, None, "assistant", "é👍"), (None, 0, "assistant", "n"),
                (3, 5, "assistant", "z" * 100000), (3, 2, "system", HOSTILE), (3, 5, "assistant", "a")]
        df = spark.createDataFrame(rows if where == "edges" else [], "conv_id long, turn long, role string, text string")
        df.selectExpr("*", "'clash' AS tree", "1 AS pos").write.parquet(f"{tmp_path}/conversations.parquet")
        folder = str(tmp_path)
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]
    found = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op1_chat_trees"](spark, folder).collect()}
    assert found == plain_digests(rows)
