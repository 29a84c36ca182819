"""Patterns against the plain expressions, disclosure on planted terms, masking."""

import hashlib
import math
import random
import re

import pytest

from tertulia.llm import pii_disclosure as P
from tertulia.llm.queries import QUERIES

from .helpers import EDGES, documents_of, python_nodes, save_tables, texts_of


def plain_findings(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[::-1][0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_patterns_equal_plain_expressions():
    rng = random.Random(3)
    parts = ["a", "B", ".", "@", "-", "+", " ", "(", ")", "1", "23", "004", "255", "256", "é", "_", "4111 1111 1111 1111", "x@y.z", "+1 (555) 010-9999", "1.2.3.4", "\n"]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 18)))
        assert [f[:3] for f in P.base_findings(text)] == plain_findings(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 200_000 + "@", "a" * 300_000 + "@", "+1" * 100_000, "+1" + "(" * 300_000, "@" * 300_000, "a@" * 100_000):
        P.base_findings(text)


@pytest.mark.parametrize("where", ["tables", "edges"])
def test_query(spark, sf_dir, tmp_path, where):
    more = [(50, "wrüte \U0001f44d a.b@c.de, 10.0.0.1 und +49 (30) 1234-567, 4111-1111-1111-1111"), (50, "x@y.z x@y.z"), (51, "1.2.3.4.5.6.7.8 300.1.1.1")]
    folder = sf_dir if where == "tables" else save_tables(spark, tmp_path, EDGES + more)
    texts = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    rows = QUERIES["op8_pii_disclosure"](spark, folder).collect()
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        wants = []
        for text in texts[r.doc_id]:
            found = plain_findings(text)
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            kinds = [f[0] for f in found]
            wants.append((*[kinds.count(k) for k in P.KINDS], hashlib.sha256(joined.encode()).hexdigest(), joined))
        mine = (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
        assert any(w[:5] == mine and r.spans.startswith(w[5]) for w in wants)


def planted():
    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(200)]
    for i in range(5):
        a, b = " ".join(rng.choices(words, k=12)), " ".join(rng.choices(words, k=12))
        rows.append((300 + i, f"{a} Zorblax, write to z.o@rb.org now {b} the Zorblax"))
    rows += [(400 + i, f"copied text near Quillon at q@u.il for all of us {rng.choice(words)}" if i == 0 else rows_text) for i, rows_text in enumerate(["copied text near Quillon at q@u.il for all of us"] * 9)]
    return rows + [(500, "Zorblax alone"), (501, None), (502, "")]


def test_disclosing_terms(spark):
    df = documents_of(spark, planted(), extra=True)
    terms = {(r.value, r.term): r for r in P.disclosing_terms(df).collect()}
    assert ("email:z.o@rb.org", "zorblax") in terms
    assert not any(t in ("wordaa", "wordba") for _, t in terms)
    # copies of one text are one context only
    assert not any(v == "email:q@u.il" for v, _ in terms)
    r = terms["email:z.o@rb.org", "zorblax"]
    assert (r.n_both, r.n_value, r.n_term) == (5, 5, 6)
    out = {x.doc_id: x for x in P.find(df).collect()}
    text = dict(planted())[300]
    want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("Zorblax", text)]
    assert [s for s in out[300].spans.split(",") if "term" in s and text[int(s.split(":")[1]):].startswith("Zor")] == want
    assert out[300].base_spans in out[300].spans and out[500].spans == ""
    clean = {x.doc_id: x for x in P.sanitise(df).collect()}
    assert P.sanitise(df).columns == df.columns
    assert "[TERM]" in clean[300].text and "[EMAIL]" in clean[300].text and "Zorblax" not in clean[300].text
    assert clean[300].n_chars == len(clean[300].text)
    assert clean[0].text == planted()[0][1] and clean[501].text is None and clean[502].text == ""


def plain_disclosing(rows, rule=P.Disclosure()):
    """Shares from the definition: sets of contexts and of texts, one entity and term after another."""
    trim = lambda w: re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w.lower())
    texts, seen = {t or "" for _, t in rows}, set()
    for text in texts:
        found = P.base_findings(text)
        hidden = list(text)
        for _, a, b, _ in found:
            hidden[a:b] = "\x00" * (b - a)
        for kind, a, b, value in found:
            words = lambda part: [w for w in re.split(r"[\s\x00]+", part) if w]
            near = words("".join(hidden[:a]))[-rule.reach:] + words("".join(hidden[b:]))[:rule.reach]
            terms = [t for t in map(trim, near) if sum(map(str.isalpha, t)) >= rule.min_letters]
            seen.add((f"{kind}:{value}", " ".join(terms)))
    out = {}
    for value in {v for v, _ in seen}:
        own = [set(c.split()) for v, c in seen if v == value]
        for term in set().union(*own):
            both, n = sum(term in c for c in own), sum(term in {trim(w) for w in re.split(r"[\x20\x09-\x0D]+", t)} for t in texts)
            if both >= rule.min_support and len(own) >= rule.min_support:
                share = math.log(len(texts) * both / (len(own) * n)) / math.log(max(len(texts) / len(own), 1.000001))
                if share >= rule.threshold:
                    out[value, term] = (both, len(own), n, round(share, 9))
    return out


def test_disclosing_terms_equal_the_definition(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma.", "delta", "x1", "42"], k=12))) for i in range(60)]
    for i in range(40):
        parts = rng.choices(["alpha", "beta,", "Gamma.", "(Klingsor)", "Zorblax", "a@b.cd", "c@d.ef;", "1.2.3.4", "y" * 500], k=rng.randint(5, 30))
        rows += [(100 + i, " ".join(parts))] * rng.choice((1, 1, 3))
    found = {(r.value, r.term): (r.n_both, r.n_value, r.n_term, round(r.share, 9)) for r in P.disclosing_terms(documents_of(spark, rows)).collect()}
    assert found == plain_disclosing(rows) and len(found) > 3


def test_words_within_reach_however_long(spark):
    """Ten words on each side count, also beside a very long one."""
    rows = [(i, f"filler text number{chr(97 + i)} without anything") for i in range(20)]
    rows += [(100 + i, f"Parsifal {'w' * 450} {'ab'[i % 2] * 3}x{chr(97 + i)} mail k.l@m.no end{chr(97 + i)}") for i in range(4)]
    terms = {(r.value, r.term) for r in P.disclosing_terms(documents_of(spark, rows)).collect()}
    assert {("email:k.l@m.no", "parsifal"), ("email:k.l@m.no", "w" * 450)} <= terms


def test_masking_overlaps(spark):
    df = documents_of(spark, [(1, "mail 1.2.3.4@x.yz, card 4111-1111-1111-1111 now")])
    assert P.sanitise(df).first().text == "mail [EMAIL], card [CARD] now"
    assert P.sanitise(df.limit(0)).count() == 0 and P.find(df.limit(0)).count() == 0


def test_copies_do_not_hide_disclosing_terms(spark):
    """An entity and its term in three distinct texts, each copied, among texts without copies."""
    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(200)]
    for i in range(3):
        a, b = " ".join(rng.choices(words, k=12)), " ".join(rng.choices(words, k=12))
        rows += [(1000 + 100 * i + k, f"{a} Zorblax, write to z.o@rb.org now {b}") for k in range(40)]
    terms = {(r.value, r.term): r for r in P.disclosing_terms(documents_of(spark, rows)).collect()}
    r = terms["email:z.o@rb.org", "zorblax"]
    assert (r.n_both, r.n_value, r.n_term) == (3, 3, 3) and abs(r.share - 1) < 1e-9
    clean = [r.text for r in P.sanitise(documents_of(spark, rows)).where("doc_id >= 1000").collect()]
    assert len(clean) == 120 and all("[TERM]" in t and "Zorblax" not in t for t in clean)


def test_one_worker_a_task(spark, tmp_path):
    """Texts are searched once in a task, and base findings masked by the worker that found them."""
    saved = lambda rows, name: (documents_of(spark, rows).write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    few = saved([(1, "mail a@b.cd"), (2, None), (3, "plain")], "few")
    assert python_nodes(P.find(few)) == python_nodes(P.sanitise(few)) == ["scan"]
    assert P.disclosing_terms(few).count() == 0
    assert P.disclosing_terms(few).dtypes == P.disclosing_terms(documents_of(spark, planted())).dtypes
    many = saved(planted(), "many")
    # texts without findings, those with some, and those whose terms are looked for
    assert sorted(python_nodes(P.find(many))) == ["scan"] * 3 + ["spans"]
    assert sorted(python_nodes(P.sanitise(many))) == ["masked"] + ["scan"] * 3 + ["spans"]
