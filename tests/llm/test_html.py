"""Main text of pages: blocks, the field against enumeration, held-out pages, the table's own markup."""

import html
import itertools
import math
import random
import re

import pytest

from tertulia.llm import html_extraction as H
from tertulia.llm.block_crf import Model, train
from tertulia.llm.html_blocks import FEATURES, blocks_of
from tertulia.llm.page_layouts import labelled_page
from tertulia.llm.queries import op11_html_extraction


@pytest.fixture(scope="module")
def model():
    return H.default_model()


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), (" \n ", []), ("plain &lt;text&gt;\n here", ["plain <text> here"]),
    ("<p>a<b>b</b>c<p>d<br>e</p>f", ["abc", "d e", "f"]),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style><title>t</title>", ["x"]),
    ("<!-- <p>no</p> --><p>1 < 2 &amp;&nbsp; 3</p><p cla", ["1 < 2 & 3"]),
    ("<p title='a > b'>quoted</p><p title=\"open>rest</p>", ["quoted", "rest"]),
    ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("<script>never closed <p>x", []), ("<!-- open <p>x", []), ("&#x41;&#66;&copy &unknown;", ["AB© &unknown;"]),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


def test_deep_and_long_pages():
    deep = "<div class=ad>" * 20000 + "x" + "</div>" * 20000 + "<p>" * 20000 + "y"
    assert [b.text for b in blocks_of(deep)] == ["x", "y"]
    assert len(blocks_of("<p>word <b>word</b>" * 30000)) == 30000
    assert len(blocks_of("<a href=\"" * 3000)) <= 1


def _weight(model, chain, labels):
    total = sum(model.score(f) for (f, _), y in zip(chain, labels, strict=True) if y)
    return total + sum(model.steps[chain[i][1]][labels[i - 1]][labels[i]] for i in range(1, len(chain)))


def test_decoding_against_enumeration():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 8):
        for _ in range(20):
            model = Model([rng.gauss(0, 1) for _ in range(6)], [[[rng.gauss(0, 1) for _ in "01"] for _ in "01"] for _ in "01"])
            chain = [(rng.randrange(64), rng.random() < 0.5) for _ in range(n)]
            best = max(itertools.product((0, 1), repeat=n), key=lambda y: _weight(model, chain, y))
            assert math.isclose(_weight(model, chain, model.decode(chain)), _weight(model, chain, best), abs_tol=1e-9)


def test_training_raises_the_likelihood_to_its_top():
    """At the weights found, small changes of any weight lower the penalised likelihood, by enumeration."""
    rng = random.Random(5)
    chains = [[(rng.randrange(8), rng.random() < 0.5) for _ in range(rng.randint(1, 5))] for _ in range(30)]
    labels = [[int((f & 1) ^ (rng.random() < 0.2)) for f, _ in c] for c in chains]
    found = train(chains, labels, 3, rounds=400)

    def goal(model):
        total = -0.025 * (sum(w * w for w in model.weights) + sum(w * w for s in model.steps for r in s for w in r))
        for c, y in zip(chains, labels, strict=True):
            paths = [_weight(model, c, z) for z in itertools.product((0, 1), repeat=len(c))]
            total += _weight(model, c, y) - math.log(sum(map(math.exp, paths)))
        return total

    top = goal(found)
    for i in range(3):
        for d in (-0.01, 0.01):
            assert goal(Model([w + d * (j == i) for j, w in enumerate(found.weights)], found.steps)) < top
    for s, a, b in itertools.product((0, 1), repeat=3):
        for d in (-0.01, 0.01):
            steps = [[[w + d * ((s, a, b) == (i, j, k)) for k, w in enumerate(r)] for j, r in enumerate(m)] for i, m in enumerate(found.steps)]
            assert goal(Model(found.weights, steps)) < top


@pytest.mark.parametrize("held_out", [False, True])
def test_held_out_pages(model, held_out):
    right = total = 0
    for seed in range(5000, 5300):
        blocks = blocks_of(labelled_page(seed, held_out))
        labels = model.decode([(b.features, b.same_parent) for b in blocks])
        right += sum((b.label == "1") == bool(y) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right / total > 0.995


def test_the_label_is_no_feature():
    page = labelled_page(11)
    bare = re.sub(r' data-label="[01]"', "", page)
    assert [b.features for b in blocks_of(page)] == [b.features for b in blocks_of(bare)] and len(FEATURES) < 90


@pytest.mark.parametrize("page, text", [
    ('<header><h1>The Site</h1><nav><a href=x>Home</a></nav></header><main><article><header><h1>Title</h1></header><section><p>First one is here, '
     'and goes on.</p></section><aside>Related: <a href=x>foo</a></aside><section class="comments"><h2>Comments</h2><p>I think this is good, really.</p>'
     '</section></article></main><div role="dialog">We use cookies. <button>OK</button></div><footer>About us</footer>', "Title First one is here, and goes on."),
    ('<div class="top-bar"><a href=x>Home</a> <a href=x>News</a></div><div class="col"><h1>My story</h1><p>First, long enough to tell.</p><div class="ad-box">'
     'Buy now!</div><p>Second one.</p></div><div class="widget"><h4>Popular</h4><ul><li><a href=x>One</a></li></ul></div><div id="disqus_thread"><p>Great '
     'article, thanks.</p></div><div>&copy; 2024 Us. All rights reserved.</div>', "My story First, long enough to tell. Second one."),
])
def test_other_layouts(model, page, text):
    assert H.main_text_of(page, model) == text


def test_query(spark, sf_dir):
    """The driver's pages mark their article; here it is cut out by the mark alone."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op11_html_extraction(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_edges_and_clashing_columns(spark, model):
    rows = [(1, None), (2, ""), (3, "<p>same</p>"), (3, "<p>same</p>"), (None, "<nav><a>x</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'old' AS text", "'k' AS label")
    out = H.extract(pages, model=model)
    assert sorted(out.columns) == ["label", "page_id", "text"]
    found = out.collect()
    assert [r.text for r in found[:2]] == ["", ""] and found[2] == found[3] and len(found) == 5
    assert H.extract(pages.limit(0), model=model).count() == 0


def test_fit_table(spark):
    pages = spark.createDataFrame([(labelled_page(i),) for i in range(60)] + [(None,)], "html string")
    model = H.fit_table(pages, limit=50)
    assert model.weights[FEATURES.index("nav")] < 0 < model.weights[FEATURES.index("article")]
