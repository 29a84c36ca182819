"""The pipeline, stage by stage, against plain versions of the stages on their own input."""

import importlib
import re
from collections import Counter, defaultdict

import pytest

from tertulia.llm import line_quality, vector_packing
from tertulia.sources.staging import shared_folder

from .helpers import EDGES, documents_of
from .test_mixing import plain_targets
from .test_native import base_counts
from .test_packing import plain_ids
from .test_pii import plain_findings
from .test_simhash import plain_components, plain_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bad_line(line):
    marks = len(re.sub(r"[\w\s]", "", line)) + line.count("_")
    visible = len(re.sub(r"[\x20\x09-\x0D]", "", line))
    separators, n = sum(c in "|»›·•" for c in line), len(re.findall(r"[^\x20\x09-\x0D]+", line))
    return (marks >= 4 and marks * 100 > visible * 12) or (separators >= 2 and n <= separators * 5) or (
        bool(re.search(line_quality.BOILERPLATE, line.lower())) and n <= 25)


def plain_quality(docs):
    out = []
    for r in docs:
        text = r.text or ""
        base = base_counts(text)
        lines = text.split("\n")
        bad = [x for x in lines if bad_line(x)]
        lost = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in bad)
        if not base["base_failed"] and lost * 100 <= base["word_chars"] * 30:
            out.append((r.doc_id, "\n".join(x for x in lines if not bad_line(x)) if bad else text))
    return out


def plain_masked(text):
    cut, at, parts = sorted((a, -b, k) for k, a, b in plain_findings(text)), 0, []
    for a, b, kind in cut:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join(parts) + text[at:]


def stages(spark, sf_dir, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = found[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return found


def test_each_stage(spark, sf_dir, tmp_path):
    found = stages(spark, sf_dir, tmp_path)
    assert list(found) == ["documents", "quality_rules", "simhash_near_dedup", "pii", "mixing", "packing"]
    assert all(df.columns == COLUMNS for name, df in found.items() if name != "packing")
    rows = {name: df.collect() for name, df in found.items()}
    pairs = lambda name: Counter((r.doc_id, r.text) for r in rows[name])
    assert pairs("quality_rules") == Counter(plain_quality(rows["documents"]))
    prints = {r.doc_id: plain_simhash(r.text) for r in rows["quality_rules"]}
    first = plain_components(prints)
    assert pairs("simhash_near_dedup") == Counter({(i, t): n for (i, t), n in pairs("quality_rules").items() if first[i] == i})
    masked = Counter((r.doc_id, plain_masked(r.text)) for r in rows["simhash_near_dedup"])
    assert pairs("pii") == masked  # no term of these few texts reveals an entity
    assert all(r.n_chars == len(r.text) for r in rows["pii"])
    source, sizes = {r.doc_id: r.source for r in rows["pii"]}, defaultdict(int)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in rows["pii"]:
        sizes[r.source] += words(r.text)
    mixed, taken = pairs("mixing"), Counter()
    for (i, text), n in mixed.items():
        assert n <= 2 * pairs("pii")[i, text]
        taken[source[i]] += n * words(text)
    for s, goal in plain_targets(sizes).items():
        assert abs(taken[s] - goal) <= max(0.05 * goal, 200)
    texts = {r.doc_id: r.text for r in rows["mixing"]}
    ids = dict(zip(texts, plain_ids(texts.values()), strict=True))
    total = sum(len(ids[i]) * n for (i, _), n in mixed.items())
    assert sum(r.length for r in rows["packing"]) == total
    once = {i for (i, _), n in mixed.items() if n == 1}
    assert {r.doc_id for r in rows["packing"]} == set(ids)
    used = defaultdict(int)
    for r in rows["packing"]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096
    kept = [r for r in rows["packing"] if r.doc_id in once]
    for r in kept:
        assert r.ids == ids[r.doc_id][r.start:r.start + r.length].astype("<u4").tobytes()


def test_run_equals_the_stages(spark, sf_dir, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = pipeline.run(spark, sf_dir)
    assert set(rows.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert pipeline.ORACLE_SQL is None and rows.count() > 0


PLAIN = " ".join(f"plain{chr(97 + i)}" for i in range(25))


@pytest.mark.parametrize("rows", [EDGES + [(None, None), (3, "again"), (3, "again")], [*EDGES, (None, PLAIN), (40, f"{PLAIN} end"), (40, f"{PLAIN} end")], []])
def test_edges(spark, tmp_path, rows):
    docs = documents_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    found = stages(spark, f"{tmp_path}/in", tmp_path / "out")
    good = plain_quality(docs.collect())
    assert found["quality_rules"].count() == len(good)
    assert (found["packing"].count() > 0) == (found["mixing"].count() > 0) == bool(good)
    assert vector_packing.END == 2


def test_clashing_columns(spark, tmp_path):
    """Columns named like a stage's own results travel unchanged through all stages but the last."""
    rows = [(i, " ".join(f"word{(i * 7 + j) % 41}{'abcdefg'[j % 7]}" for j in range(40 + i))) for i in range(12)]
    docs = documents_of(spark, rows, extra=True)
    for name, stage in importlib.import_module("corpus_pipeline").STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0 and {r.kept for r in docs.collect()} == {"other"}, name


def test_nothing_is_left_but_the_last_table(spark, sf_dir):
    import glob
    before = set(glob.glob(f"{shared_folder(spark)}/pipeline-*"))
    importlib.import_module("corpus_pipeline").run(spark, sf_dir).count()
    left = [p for base in set(glob.glob(f"{shared_folder(spark)}/pipeline-*")) - before for p in glob.glob(f"{base}/*")]
    assert [p.rsplit("/", 1)[1] for p in left] == ["mixing"]
