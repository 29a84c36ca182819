"""Periodic runs of words, by recompression.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``MIN_LENGTH`` words and
``MIN_POWERS`` periods long, that no neighbouring word extends.  A run of period q holds ``MIN_POWERS`` places of the grid
0, q, 2q, ... one after another, so every q is tried on its grid only (a harmonic sum, n log n places):
places whose words agree over the powers are candidates.  The texts that have candidates get a run-length grammar
(``run_grammar``), whose exact extensions to both sides give the whole run.  A stretch found under several periods has
the smallest of them.

One text at a time is worked on in a task, short ones together; memory grows with one text (some 200 bytes a word),
never with the table.  There is no shuffle.

Defined results: NULL and blank texts have no words and no run; equal texts and repeated rows give equal results, one row
each; an empty table gives an empty one; other columns are not looked at and none of their names is used; NULL ids are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tertulia.llm.run_grammar import Grammar

MIN_LENGTH, MIN_POWERS = 6, 4
CHUNK_WORDS = 1 << 17   # words of short texts that are worked on together
GRID_PLACES = 1 << 19   # grid places looked at in one go

Change = Callable[[object, list[bytes]], list[bytes]]


def _grid(offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of every grid place with ``MIN_POWERS`` grid places from it on inside its text, in slices."""
    periods = lengths // MIN_POWERS
    text = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (lengths[text] - 1) // q - (MIN_POWERS - 2)
    ends = np.cumsum(count)
    done = 0
    while done < len(text):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + GRID_PLACES, "right")))
        rows = slice(done, upto)
        t, period, n = text[rows], q[rows], count[rows]
        spot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        period, t = np.repeat(period, n), np.repeat(t, n)
        yield t, offsets[t] + spot * period, period
        done = upto


def _candidates(ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid places whose words agree over the powers, there and half a period on (a run shows both), in slices."""
    for text, place, q in _grid(offsets, lengths):
        for power in range(1, MIN_POWERS):
            same = ids[place] == ids[place + power * q]
            text, place, q = text[same], place[same], q[same]
        half = q // 2
        for power in range(1, MIN_POWERS - 1):
            same = ids[place + half] == ids[place + half + power * q]
            text, place, q, half = text[same], place[same], q[same], half[same]
        if len(text):
            yield text, place, q


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one sequence, each ended by a number that stands nowhere else; where each begins; lengths."""
    lengths = np.array([len(x) for x in texts], np.int64)
    size = max(int(x.max()) + 1 for x in texts if len(x))
    return np.concatenate([np.append(x, size + i) for i, x in enumerate(texts)]), np.cumsum(lengths + 1) - (lengths + 1), lengths


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text, given as numbers of its words: rows (start, length, period) by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not any(len(x) for x in texts):
        return out
    held = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(t) for t, _, _ in _candidates(*_joined(texts))]]))
    if not len(held):
        return out
    # Only the texts that may have a run get a grammar.
    ids, offsets, lengths = _joined([texts[i] for i in held])
    grammar = Grammar(ids, target=2 * len(held))
    found = []
    for t, place, q in _candidates(ids, offsets, lengths):
        after, before = grammar.extensions(place, place + q), grammar.extensions(place, place + q, forward=False)
        long = after + before + q >= np.maximum(MIN_LENGTH, MIN_POWERS * q)
        rows = np.stack([t, place - before - offsets[t], after + before + q, q], axis=1)[long]
        found.append(np.unique(rows, axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # Of one stretch the smallest period counts; rows are in order of it.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for i, own in zip(held, np.split(rows, np.searchsorted(rows[:, 0], np.arange(1, len(held)))), strict=True):
        out[i] = own[:, 1:]
    return out


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _unchanged(key: object, words: list[bytes]) -> list[bytes]:
    return words


def _rows(keys: list, words: list[list[bytes]]) -> pd.DataFrame:
    numbered = []
    for text in words:
        known: dict[bytes, int] = {}
        numbered.append(np.fromiter((known.setdefault(w, len(known)) for w in text), np.int64, len(text)))
    out = []
    for key, text, runs in zip(keys, words, runs_of(numbered), strict=True):
        if len(runs):
            kept = np.flatnonzero(~dropped(len(text), runs)).tolist()
            text_left = b" ".join([text[i] for i in kept])
        else:
            text_left = b" ".join(text)
        listed = [{"start": a, "length": n, "period": q} for a, n, q in runs.tolist()]
        out.append((key, len(text), listed, text_left.decode()))
    return pd.DataFrame(out, columns=["key", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Change = _unchanged) -> DataFrame:
    """Per row: key, n_words, runs (start, length, period), and collapsed, the words left when runs keep one period.

    ``change`` may exchange a text's words first; it gets the key and the words as UTF-8.
    """
    def work(batches):
        for batch in batches:
            keys: list = []
            words: list[list[bytes]] = []
            held = 0
            for k, value in zip(batch["key"], batch["text"], strict=True):
                k = None if pd.isna(k) else k
                keys.append(k)
                # bytes.split() cuts at exactly the blanks meant.
                words.append(change(k, (value or "").encode().split()))
                held += len(words[-1])
                if held >= CHUNK_WORDS:
                    yield _rows(keys, words)
                    keys, words, held = [], [], 0
            if keys:
                yield _rows(keys, words)

    kind = docs.schema[key].dataType
    narrow = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    found = narrow.mapInPandas(work, f"key string, {SCHEMA}")
    return found.select(F.col("key").cast(kind).alias(key), "n_words", "runs", "collapsed")


def repeated_tail(key: object, words: list[bytes]) -> list[bytes]:
    """The change the contract plants: a tenth of the texts, by key, go on with a repeated stretch of their words."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    times = -(-(n - a) // len(period))
    return words[:a] + (period * times)[:n - a]


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result the contract asks for: number of runs, the longest, and digests of runs and of what is left."""
    runs = F.col("runs")
    # Longest first; ties by start, then period.
    longest = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    rows = found.withColumn("__top", longest)
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("__top.s").alias("start"), (-F.col("__top.n")).alias("length"),
        F.col("__top.p").alias("period"),
        F.floor(F.lit(1000) * -F.col("__top.n") / F.col("__top.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )

