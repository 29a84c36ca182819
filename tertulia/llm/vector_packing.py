"""Packing by vector bin packing.

Examples are placed under three limits at once: tokens, segments and loss-bearing tokens of a sequence.  A
sequence takes, of all examples that still fit whole, the one whose demand vector has the largest dot product with the
room left (both as shares of the limits), so that examples heavy in what the sequence has plenty of go first.
When none fits, an example is cut to fill the rest; so sequences run full and only few examples are cut.
Sequences that a limit, or the end of the data, leaves below ``tokens`` are split at powers of two,
which need no padding.

Each task packs its own partition from a bounded pool of examples: nothing is shuffled, and a task that runs again
over the same rows gives the same sequences.

Defined results: NULL text counts as empty, NULL prompts too; an empty text is the end token alone; repeated rows
are separate examples; texts longer than a sequence are cut; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tertulia.llm.common import in_chunks

END = 2
POOL_TOKENS = 1 << 20
POOL_EXAMPLES = 4096
CHUNK_CHARS = 1 << 21
CACHE_WORDS = 500_000
SLICE_ROWS = 512
NEVER = 1 << 60

# A word of Latin letters with one end mark is the same tokens as the letters, then the mark.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,]?)$"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096


class Encoder:
    """Token ids of whole texts by the tokenizer's own encoding of their distinct words.

    The tokenizer normalises and splits inside words only (at white space it always splits), so a text's ids are
    those of its words, one after another.  Words met before are kept, up to ``CACHE_WORDS``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"}
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.table = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, which one text can hold: its ids tell where words end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._encode(words)

    @staticmethod
    def _parts(words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        found = [encode(words.slice(i, 8192).to_numpy(zero_copy_only=False).tolist()) for i in range(0, len(words), 8192)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _learn(self, new: pa.Array) -> None:
        """Adds the ids of words: letters with or without an end mark by their letters, all others whole."""
        parsed = pc.extract_regex(new, PLAIN)
        plain = pc.is_valid(parsed)
        named = parsed.filter(plain)
        if len(named):
            stems = pc.utf8_lower(named.field("stem")).dictionary_encode()
            ids, sizes = self._parts(stems.dictionary, self._encode_letters)
            own = stems.indices.to_numpy()
            mark = np.select([pc.equal(named.field("mark"), m).to_numpy(zero_copy_only=False) for m in self.marks], list(self.marks.values()), -1)
            n = sizes[own] + (mark >= 0)
            ends = np.cumsum(n)
            last = ends[mark >= 0] - 1
            take = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[own] - (ends - n), n)
            take[last] = 0
            out = ids[take]
            out[last] = mark[mark >= 0]
            self._add(new.filter(plain), out, n)
        others = new.filter(pc.invert(plain))
        if len(others):
            self._add(others, *self._parts(others, self._encode))

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.table = np.concatenate((self.table, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        blank = pa.array(texts, pa.large_string())
        for c in "\t\n\x0b\x0c\r":
            if any(c in t for t in texts):
                blank = pc.replace_substring(blank, c, " ")
        lists = pc.split_pattern(blank, " ")
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary
        code = pc.index_in(words, value_set=self.words)
        if code.null_count:
            new = words.filter(pc.is_null(code))
            if len(self.words) + len(new) > CACHE_WORDS:
                self._forget()
                new = words
            self._learn(new)
            code = pc.index_in(words, value_set=self.words)
        code = code.to_numpy()[flat.indices.to_numpy()]
        begins = self.ends[code]
        n = self.ends[code + 1] - begins
        ends = np.cumsum(n)
        # token k of the texts is token k - (start of its word) of that word
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - n), n)
        tokens = self.table[at]
        bounds = np.concatenate(([0], ends))[np.asarray(lists.offsets)]
        return [tokens[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Pool:
    """Examples waiting, by demand vector: (tokens, one segment, loss tokens)."""

    def __init__(self, limits: Limits):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss_tokens])
        self.rows: dict[tuple[int, int], int] = {}
        self.waiting: list[list[tuple[int, int, int, int]]] = []
        self.need, self.share = np.zeros((64, 3), np.int64), np.zeros((64, 3))
        self.tokens = self.examples = self.empty = 0

    def add(self, number: int, start: int, length: int, free: int) -> None:
        """``free``: the example's first tokens that bear no loss."""
        vector = (length, length - min(length, max(0, free - start)))
        row = self.rows.get(vector)
        if row is None:
            row = self.rows[vector] = len(self.waiting)
            self.waiting.append([])
            if row == len(self.need):
                self.need = np.concatenate((self.need, np.zeros_like(self.need)))
                self.share = np.concatenate((self.share, np.zeros_like(self.share)))
            self.need[row] = (length, 1, vector[1])
            self.share[row] = self.need[row] / self.limits
        elif not self.waiting[row]:
            self.need[row] = (length, 1, vector[1])
            self.empty -= 1
        self.waiting[row].append((number, start, length, free))
        self.tokens += length
        self.examples += 1

    def _take(self, row: int) -> tuple[int, int, int, int]:
        item = self.waiting[row].pop()
        if not self.waiting[row]:
            self.need[row] = NEVER
            self.empty += 1
        self.tokens -= item[2]
        self.examples -= 1
        return item

    def _tidy(self) -> None:
        """Drops vectors without examples once they are most of the table."""
        if self.empty > 64 and 2 * self.empty > len(self.waiting):
            items = [x for w in self.waiting for x in w]
            self.rows, self.waiting, self.tokens, self.examples, self.empty = {}, [], 0, 0, 0
            for x in items:
                self.add(*x)

    def sequence(self) -> list[tuple[int, int, int]]:
        """One sequence of pieces (number, start, length)."""
        self._tidy()
        room, pieces = self.limits.copy(), []
        while self.examples and room[0] > 0 and room[1] > 0:
            n = len(self.waiting)
            need = self.need[:n]
            score = self.share[:n] @ (room / self.limits)
            fits = (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
            score[~fits] = -1.0
            row = int(np.argmax(score))
            whole = bool(fits[row])
            if not whole:  # none fits
                score = np.where(need[:, 0] < NEVER, self.share[:n] @ (room / self.limits), -1.0)
                row = int(np.argmax(score))
            number, start, length, free = self._take(row)
            take = length
            if not whole:  # cut: as many tokens as the room for tokens and for loss allows
                silent = min(length, max(0, free - start))
                take = min(length, int(room[0]), silent + int(room[2]))
                if take < length:
                    self.add(number, start + take, length - take, free)
                if take == 0:
                    break
            room -= (take, 1, take - min(take, max(0, free - start)))
            pieces.append((number, start, take))
        return pieces


def at_powers(pieces: list[tuple[int, int, int]], full: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces as one sequence when it is full or a power of two, else as sequences of powers of two."""
    left = sum(p[2] for p in pieces)
    if left == full:
        yield pieces
        return
    rest = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        own = []
        while size:
            number, start, length = rest.pop()
            take = min(size, length)
            own.append((number, start, take))
            if take < length:
                rest.append((number, start + take, length - take))
            size -= take
        yield own


def _packed(batches, path: str, limits: Limits, key_type: pa.DataType):
    encode, part = encoder(path), TaskContext.get().partitionId()
    pool, held, counter, number = Pool(limits), {}, 0, 0
    rows: list[tuple] = []
    waiting = 0

    def emit(pieces):
        nonlocal counter, waiting
        for own in at_powers(pieces, limits.tokens):
            offset = 0
            for n, start, length in own:
                key, ids, left = held[n]
                piece = ids[start:start + length]
                rows.append((key, start, length, len(ids), (part << 36) + counter, offset, piece.astype("<u4").tobytes()))
                waiting += length
                offset += length
                held[n][2] = left - length
                if held[n][2] == 0:
                    del held[n]
            counter += 1

    def batch():
        nonlocal rows, waiting
        names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows, waiting = [], 0
        return out

    for b in (batch.slice(i, SLICE_ROWS) for batch in batches for i in range(0, batch.num_rows, SLICE_ROWS)):
        keys, texts, prompts = (b.column(i).to_pylist() for i in range(3))
        at = 0
        for chunk in in_chunks((p + t for p, t in zip(prompts, texts, strict=True)), CHUNK_CHARS):
            own = slice(at, at + len(chunk))
            at += len(chunk)
            frees = [len(x) for x in encode(prompts[own])] if any(prompts[own]) else [0] * len(chunk)
            heads = encode(prompts[own]) if any(frees) else [np.empty(0, np.uint32)] * len(chunk)
            for key, head, body, free in zip(keys[own], heads, encode(texts[own]), frees, strict=True):
                ids = np.concatenate((head, body, np.array([END], np.uint32)))  # a copy: the chunk's tokens can go
                held[number] = [key, ids, len(ids)]
                pool.add(number, 0, len(ids), free)
                number += 1
            while pool.tokens >= POOL_TOKENS or pool.examples >= POOL_EXAMPLES:
                emit(pool.sequence())
                if waiting >= POOL_TOKENS:
                    yield batch()
    while pool.examples:
        emit(pool.sequence())
        if waiting >= POOL_TOKENS:
            yield batch()
    if rows:
        yield batch()


def _released(batches, path: str, limits: Limits, key_type: pa.DataType):
    """``_packed``; a worker that waits for its next task holds no memory in reserve beside the words it knows."""
    try:
        yield from _packed(batches, path, limits, key_type)
    finally:
        pa.default_memory_pool().release_unused()


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", prompt: str | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and ``ids`` (unsigned 32-bit, little-endian).

    ``prompt`` names a column of text that stands before ``text`` and bears no loss.  ``tokenizer`` is a path
    each executor can read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("limits must be positive")
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", kind), *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()),
    ])
    arrow = to_arrow_type(kind)
    rows = docs.select(
        key, F.coalesce(text, F.lit("")).alias("text"), F.coalesce(prompt, F.lit("")) if prompt else F.lit(""))
    return rows.mapInArrow(lambda it: _released(it, tokenizer, limits, arrow), schema).withColumnRenamed("key", key)
