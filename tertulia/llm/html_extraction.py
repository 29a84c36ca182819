"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A page becomes the chain of its text blocks (``html_blocks``): bits for ancestor tags and the words in their names, and for what the
text looks like.  The field (``block_crf``) is trained on labelled pages and labels each chain by Viterbi's path; the
blocks labelled as article, in page order, are the main text.  One page is one row: there is no shuffle, and memory grows
with one page.

Labelled pages carry ``data-label`` (1 article, 0 furniture) on their elements.  Without any of the caller's, ``N_LAYOUTS``
pages built from known layouts (``page_layouts``) teach the field; at most ``MAX_TRAIN`` labelled pages are used.

Defined results: NULL, empty and text-free pages give an empty text; a page that is plain text without tags is one block;
unclosed and stray tags are mended as they come, an unfinished tag at the end is dropped; equal pages give equal texts, one per row;
an empty table gives an empty one; all columns are kept, the result stands in the column the caller names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tertulia.llm.block_crf import Model, train
from tertulia.llm.html_blocks import FEATURES, blocks_of
from tertulia.llm.page_layouts import labelled_page

N_LAYOUTS, MAX_TRAIN = 400, 2000


def fit(pages: Iterable[str]) -> Model:
    """The field of labelled pages; blocks outside every labelled element count as furniture."""
    chains, labels = [], []
    for page in pages:
        blocks = blocks_of(page)
        chains.append([(b.features, b.same_parent) for b in blocks])
        labels.append([int(b.label == "1") for b in blocks])
    return train(chains, labels, len(FEATURES))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_page(i) for i in range(N_LAYOUTS))


def fit_table(labelled: DataFrame, html: str = "html", limit: int = MAX_TRAIN) -> Model:
    """The field of a caller's table of labelled pages, the ``limit`` of them with the smallest hashes."""
    rows = labelled.select(F.col(html).alias("page")).where(F.col("page").isNotNull())
    return fit(r.page for r in rows.orderBy(F.xxhash64("page"), "page").limit(limit).collect())


def main_text_of(page: str | None, model: Model) -> str:
    blocks = blocks_of(page)
    labels = model.decode([(b.features, b.same_parent) for b in blocks])
    return " ".join(b.text for b, label in zip(blocks, labels, strict=True) if label)


def main_text(html: Column | str, model: Model | None = None) -> Column:
    """The article's text as a column."""
    chosen = model or default_model()
    lean = Model(chosen.weights, chosen.steps)

    @F.pandas_udf(T.StringType())
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text_of(p, lean) for p in pages], dtype=object)

    return extracted(html)


def extract(pages: DataFrame, html: str = "html", text: str = "text", model: Model | None = None) -> DataFrame:
    """All columns of ``pages`` but ``html``, and the main text in ``text`` (in place of a column of that name)."""
    return pages.withColumn(text, main_text(html, model)).drop(*([html] if html != text else []))
