import math

import pytest

from tertulia.functions import content as C
from tertulia.functions.detectors import model_tagger
from tertulia.functions.lexicon import spanish_adjectives
from tertulia.operators import content, tokens


@pytest.mark.parametrize("text, found", [
    ("👍🏽👍", ["👍🏽", "👍"]), ("❤️", ["❤️"]), ("👨‍👩‍👧", ["👨‍👩‍👧"]), ("🇲🇽🇺🇸", ["🇲🇽", "🇺🇸"]), ("1️⃣ #⃣", ["1️⃣", "#⃣"]),
    ("a1#*", []), ("©", ["©"]), ("🏴󠁧󠁢󠁥󠁮󠁧󠁿", ["🏴󠁧󠁢󠁥󠁮󠁧󠁿"]), ("✀ 中 ñ", []), ("🕵🏻‍♂️!", ["🕵🏻‍♂️"]), ("🫠", ["🫠"]),
])
def test_emojis(on_texts, text, found):
    assert on_texts(C.extract_emojis, [text]) == [found]


@pytest.mark.parametrize("text, found", [
    ("https://GitHub.com/a", ["https://Git"]), ("https://", []), ("ve https://a.b/c?x=1, y", ["https://a.b/c"]),
    ("https://a.bhttps://c.d", ["https://a.b", "https://c.d"]), ("(https://a.b).", ["https://a.b)"]),
    ("https://a.b<c", []), ("http://a.b.;:", ["http://a.b"]), ("www.a.b", []),
])
def test_links(on_texts, text, found):
    assert on_texts(C.extract_links, [text]) == [found]


@pytest.mark.parametrize("url, domain, strict", [
    ("https://www.YouTube.com/watch?v=1", "youtube.com", "youtube.com"), ("http://youtu.be/x", "youtube.com", "youtube.com"),
    ("https://mx.linkedin.com", "linkedin.com", "linkedin.com"), ("https://lnkd.in/x", "linkedin.com", "linkedin.com"),
    ("https://netflix.com/x", "x.com", "netflix.com"), ("https://x.com:443/a", "x.com", "x.com"),
    ("https://pages.github.io", "github.com", "pages.github.io"), ("https://a.mx:80#f", "a.mx:80", "a.mx:80"),
    ("https://", "Desconocido", "Desconocido"), (" https://Dev.to?x ", "dev.to", "dev.to"),
])
def test_domains(on_texts, url, domain, strict):
    assert on_texts(C.url_domain, [url]) == [domain]
    assert on_texts(lambda c: C.url_domain(c, strict=True), [url]) == [strict]


def test_frequencies(messages):
    df = messages(("t", "a", "👍👍 😀 https://a.mx https://youtu.be/x"), ("t", "Sistema", "👍 https://youtube.com"), ("t", "b", None))
    assert [tuple(r) for r in content.emoji_frequency(df, 1).collect()] == [("👍", 3)]
    assert [tuple(r) for r in content.top_shared_domains(df).collect()] == [("youtube.com", 2), ("a.mx", 1)]
    assert content.top_shared_domains(messages(("t", "a", "x"))).columns == ["dominio", "count"]


def test_adjectives(spark, messages):
    df = messages(("t", "a", "nueva idea nueva y buena"), ("t", "a", "cosas buenas, muy reales"))
    words = tokens.tokenize(df)
    found = content.adjective_frequency(words, spanish_adjectives(spark)).collect()
    assert [tuple(r) for r in found] == [("nueva", 2), ("buena", 1), ("buenas", 1), ("reales", 1)]
    assert [tuple(r) for r in content.adjective_frequency(words, spanish_adjectives(spark), ["nueva"], 1).collect()] == [("buena", 1)]

    def load():
        return lambda texts: [[(w, "ADJ" if w.startswith("nuev") else "X") for w in t.split()] for t in texts]

    tagged = content.adjective_frequency_tagged(df, model_tagger(load), "message")
    assert [tuple(r) for r in tagged.collect()] == [("nueva", 2)]


def likelihood(c12, c1, c2, n):
    part = lambda k, m, x: math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (m - k)
    if n in (c1, c2):
        return 0
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    return -2 * (part(c12, c1, p) + part(c2 - c12, n - c1, p) - part(c12, c1, p1) - part(c2 - c12, n - c1, p2))


def test_collocations_and_weights(messages):
    texts = ["vibe engineering mola"] * 20 + ["sol luna"] * 3 + ["agente agentes agentes", "gas", "the sol", "x 77 sol"]
    counts = content.word_and_pair_counts(tokens.tokenize(messages(*[("t", "a", t) for t in texts])))
    total = 20 * 3 + 3 * 2 + 3 + 1 + 1 + 1 + 1
    pairs = {r.bigram: (r["count"], r.score) for r in content.bigram_collocations(counts).collect()}
    assert set(pairs) == {"vibe engineering", "engineering mola"}
    assert pairs["vibe engineering"] == (20, pytest.approx(likelihood(20, 20, 20, total)))
    weights = {r.term: (r["count"], r.weight) for r in content.term_weights(counts).collect()}
    # Each collocation takes its count off both words; "engineering" falls below zero.
    assert weights == {
        "vibe engineering": (20, 1.0), "engineering mola": (20, 1.0), "sol": (5, 0.25),
        "luna": (3, 0.15), "agente": (3, 0.15), "gas": (1, 0.05), "x": (1, 0.05),
    }
    top = content.term_weights(counts, max_terms=2).collect()
    assert [r.term for r in top] == ["engineering mola", "vibe engineering"]


def test_single_letters_are_optional(messages):
    words = tokens.tokenize(messages(("t", "a", "z sol")))
    terms = lambda **o: {r.term for r in content.term_weights(content.word_and_pair_counts(words, **o)).collect()}
    assert terms(min_length=2) == {"sol"}
    assert terms() == {"z", "sol"}


def test_repeated_pair(messages):
    words = tokens.tokenize(messages(*[("t", "a", "bip bip")] * 30, *[("t", "a", "mar")] * 30))
    rows = content.term_weights(content.word_and_pair_counts(words)).collect()
    assert {r.term: r["count"] for r in rows} == {"mar": 30, "bip bip": 30}


def test_clouds_by_chat(spark):
    """A small chat keeps its terms, a NULL chat too; each group's scores are those of the group alone."""
    texts = {"big": ["vibe engineering mola"] * 300 + ["gas"], "small": ["sol luna"] * 20 + ["mar"] * 20, None: ["bip bop"] * 20 + ["mar"] * 20}
    rows = [(c, "t", "a", x) for c, xs in texts.items() for x in xs]
    words = tokens.tokenize(spark.createDataFrame(rows, "chat_id string, timestamp string, sender string, message string")).localCheckpoint()
    counts = content.word_and_pair_counts(words, by=["chat_id"]).localCheckpoint()
    found = content.term_weights(counts, max_terms=2, by=["chat_id"]).collect()
    pairs = content.bigram_collocations(counts, by=["chat_id"]).collect()
    assert {r.chat_id for r in found} == set(texts)
    for chat in texts:
        alone = content.word_and_pair_counts(words.where(words.chat_id.eqNullSafe(chat))).localCheckpoint()
        want = [tuple(r) for r in content.term_weights(alone, max_terms=2).collect()]
        assert sorted(tuple(r)[1:] for r in found if r.chat_id == chat) == sorted(want)
        own = {r.bigram: (r["count"], pytest.approx(r.score)) for r in content.bigram_collocations(alone).collect()}
        assert {r.bigram: (r["count"], r.score) for r in pairs if r.chat_id == chat} == own
