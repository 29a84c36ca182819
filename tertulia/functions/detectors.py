"""Detectors and taggers backed by a Python model.

The model is loaded once per Python worker and called once per Arrow batch; nothing here is
needed unless a caller passes such a detector.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

SpanModel = Callable[[list[str]], list[list[str]]]
TagModel = Callable[[list[str]], list[list[tuple[str, str]]]]


# Models of this worker process, by the detector they belong to: a loader arrives anew with each task.
_MODELS: dict[str, object] = {}


def _loaded(name: str, load: Callable[[], object]):
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def _on_texts(texts: pd.Series, model: Callable[[list[str]], list]) -> pd.Series:
    """The model's answers; empty texts get an empty one without a call."""
    full = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
    out: list[list] = [[] for _ in range(len(texts))]
    if full:
        for i, found in zip(full, model([texts.iloc[i] for i in full]), strict=True):
            out[i] = found
    return pd.Series(out)


def model_detector(load: Callable[[], SpanModel]) -> Callable[[Column], Column]:
    """Column detector of person names from ``load()``: texts -> lists of names."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(name, load)
        for texts in batches:
            yield _on_texts(texts, model)

    return spans


def model_tagger(load: Callable[[], TagModel]) -> Callable[[Column], Column]:
    """Column tagger from ``load()``: texts -> lists of (token, part of speech)."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<struct<token:string,pos:string>>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(name, load)
        tagged = lambda texts: [[{"token": t, "pos": p} for t, p in row] for row in model(texts)]
        for texts in batches:
            yield _on_texts(texts, tagged)

    return tags
