"""Removal of long repeats with run-length indexes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller number.  No index holds
the whole corpus.  Every string of ``LENGTH`` bytes has an anchor, the ``K`` bytes in it with the smallest hash, and equal strings have equal
anchors.  So

1. each task lists the anchors of its texts, one entry per distinct anchor and chunk of texts; buckets of entries tell
   which anchors occur in several texts;
2. texts that hold such an anchor, one of each group of equal texts, are cut into segments: the bytes of all strings that
   share one occurrence of an anchor.  Equal segments are merged, and segments go to buckets by anchor;
3. each bucket builds a run-compressed Burrows-Wheeler transform of its segments (``run_index``) and streams every segment
   through it; the statistic at a position is the smallest document with the ``LENGTH`` bytes that start there.  Where
   all segments of an anchor are equal, they have merged into one and its smallest document is the statistic at once;
4. marks return to their texts, which are cut.  Whole copies of a smaller document need no more than their hash.

The text is shuffled once, by parts of equal size; steps 2 and 4 read the same shuffle.

Buckets are sized by bytes, so their number grows with the corpus.  A passage in very many documents costs its bucket the segment
once and 16 bytes for each document.

Defined results: NULL text counts as empty; texts under ``LENGTH`` bytes stay whole; NULL numbers count as larger than
all others; documents of one number never cut each other; repeated rows are treated alike; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tertulia.llm.common import checkpointed, text_of
from tertulia.llm.run_index import RunIndex

LENGTH, K = 50, 24
WINDOWS = LENGTH - K + 1
WIDEST = LENGTH + WINDOWS - 1  # bytes of a segment at most
CHUNK = 1 << 21
ANCHOR_BYTES, SEGMENT_BYTES, GROUP_BYTES = 48 << 20, 5 << 20, 4 << 20  # text bytes for each bucket or group
U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join([np.array([len(arrays), *map(len, arrays)], np.int64).tobytes(), *[a.tobytes() for a in arrays]])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(blob, np.int64, n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _anchors(buf: np.ndarray, ends_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: first start, last start, hash of the anchor (59 bits).

    ``ends_of``: for every byte the end of its piece.
    """
    n = len(buf) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U),)
    x = buf.astype(U)
    for by in (1, 2, 4):
        x = x[:-by] | x[by:] << U(8 * by)
    x = x[:-16] * ODD[0] + x[8:-8] * ODD[1] + x[16:] * ODD[2]
    x ^= x >> U(32)
    x *= ODD[3]
    x ^= x >> U(29)
    # the low bits hold the place, so that a minimum tells where it stands
    x = (x & ~U(31)) | (np.arange(len(x), dtype=np.int64) & 31).astype(U)
    for by in (1, 2, 4, 8):
        x = np.minimum(x[:-by], x[by:])
    x = np.minimum(x[:-(WINDOWS - 16)], x[WINDOWS - 16:])[:n]
    at = np.flatnonzero(np.arange(LENGTH, n + LENGTH) <= ends_of[:n])
    if not len(at):
        return at, at, np.empty(0, U)
    own = x[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(at)) - 1
    return at[starts], at[lasts], own[starts] >> U(5)


def _chunks(column: pa.Array) -> Iterator[tuple]:
    """Bytes of texts in chunks of pieces: (bytes, row of each piece, offset in its text, start, size).

    Texts over a chunk are cut into pieces that overlap by one byte less than a string.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    held: list[tuple[int, int, int]] = []
    size = 0

    def chunk():
        rows, froms, sizes = (np.array(x, np.int64) for x in zip(*held, strict=True))
        buf = np.concatenate([data[a:a + n] for _, a, n in held])
        return buf, rows, froms - offsets[rows], np.cumsum(sizes) - sizes, sizes

    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a >= LENGTH:
            n = min(b - a, CHUNK)
            held.append((row, a, n))
            size += n
            a += n - LENGTH + 1 if n < b - a else b - a
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


def _split(order_key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices) for each distinct key."""
    order = np.argsort(order_key, kind="stable")
    ordered = order_key[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(order_key[part[0]]), part


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(rows, return_counts=True)
    return found, counts.astype(np.uint32)


_ENTRIES = "bucket long, part long, blob binary"


def _list_anchors(buckets: int, parts: int):
    """Entries by bucket; anchors that a chunk shows to be shared go on to their texts' part at once."""
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        for b in batches:
            s = b.column(0).to_numpy()
            for buf, rows, _, starts, sizes in _chunks(b.column(1)):
                first, _, h = _anchors(buf, np.repeat(starts + sizes, sizes))
                doc = rows[np.repeat(np.arange(len(rows)), sizes)[first]]
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                heads = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                several = np.repeat(np.diff(heads, append=len(h)) > 1, np.diff(heads, append=len(h)))
                bucket, low = (h >> U(32)) % U(buckets), (h & U(0xFFFFFFFF)).astype(np.uint32)
                out = []
                keep = np.ones(len(h), bool)
                keep[several] = False
                keep[heads] = True  # a shared anchor is named once, without a text
                doc_or_none = np.where(several, -1, doc)[keep]
                low_k = low[keep]
                for k, at in _split(bucket[keep].astype(np.int64)):
                    at = at[np.argsort(doc_or_none[at], kind="stable")]
                    ids, counts = _counted(doc_or_none[at])
                    known = ids < 0
                    out.append((k, None, _pack(np.where(known, 0, s[ids]), known.astype(np.uint8), counts, low_k[at])))
                key = bucket << U(32) | low
                for p, at in _split((s[doc[several]] % parts).astype(np.int64)):
                    at = np.flatnonzero(several)[at]
                    at = at[np.argsort(doc[at], kind="stable")]
                    ids, counts = _counted(doc[at])
                    out.append((int(bucket[at[0]]), p, _pack(s[ids], counts, key[at])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return run


def _shared_anchors(parts: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        through = pdf[pdf["part"].notna()]
        out = list(zip(through["part"].astype(int), through["blob"], strict=True))
        ids, knowns, counts, lows = [], [], [], []
        for blob in pdf.loc[pdf["part"].isna(), "blob"]:
            s, known, n, low = _unpack(blob, np.int64, np.uint8, np.uint32, np.uint32)
            ids.append(s)
            knowns.append(known)
            counts.append(n)
            lows.append(low)
        if ids:
            counts = np.concatenate(counts)
            s, known = np.repeat(np.concatenate(ids), counts), np.repeat(np.concatenate(knowns), counts)
            low = np.concatenate(lows)
            order = np.argsort(low, kind="stable")
            ordered = low[order]
            same = ordered[1:] == ordered[:-1]
            shared = np.zeros(len(low), bool)
            shared[order[1:][same]] = True
            shared[order[:-1][same]] = True
            at = np.flatnonzero(shared & (known == 0))
            for p, own in _split(s[at] % parts):
                own = at[own]
                own = own[np.argsort(s[own], kind="stable")]
                who, n = _counted(s[own])
                out.append((p, _pack(who, n, U(key[0]) << U(32) | low[own].astype(U))))
        return pd.DataFrame(out, columns=["part", "blob"])
    return run


def _places(texts: pd.DataFrame) -> pd.DataFrame:
    """The distinct texts of a part in the order of s; a text's place in it stands for it."""
    return texts.drop_duplicates("s").sort_values("s", ignore_index=True)


def _segments(anchor_buckets: int, buckets: int):
    powers: list[np.ndarray] = []

    def run(key, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Segments of the texts that stand for their group and hold shared anchors."""
        texts = _places(texts)
        wanted = np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in found["own"] if x is not None]])
        who, keys = [np.empty(0, np.int64)], [np.empty(0, U)]
        for blob in found["blob"]:
            if blob is not None:
                s, n, k = _unpack(blob, np.int64, np.uint32, U)
                who.append(np.repeat(s, n))
                keys.append(k)
        who, keys = np.concatenate(who), np.concatenate(keys)
        order = np.lexsort((keys, who))
        who, keys = who[order], keys[order]
        left, right = (np.searchsorted(who, texts["s"].to_numpy(), side) for side in ("left", "right"))
        places = np.flatnonzero((left < right) & texts["s"].isin(wanted).to_numpy())
        if not len(places):
            return pd.DataFrame({"bucket": [], "blob": []})
        left, right, ids = left[places], right[places], texts["id"].to_numpy()[places]
        column = pa.array(texts["text"].to_numpy()[places], pa.binary())
        inverse, out = U(pow(int(ODD[0]), -1, 1 << 64)), []
        for buf, rows, froms, starts, sizes in _chunks(column):
            first, last, h = _anchors(buf, np.repeat(starts + sizes, sizes))
            piece = np.repeat(np.arange(len(rows)), sizes)[first]
            own_key = ((h >> U(32)) % U(anchor_buckets)) << U(32) | (h & U(0xFFFFFFFF))
            cuts = np.searchsorted(piece, np.arange(len(rows) + 1))
            good = np.zeros(len(h), bool)
            for row, x, y in zip(rows, cuts[:-1], cuts[1:], strict=True):
                own = keys[left[row]:right[row]]
                at = np.minimum(np.searchsorted(own, own_key[x:y]), len(own) - 1)
                good[x:y] = own[at] == own_key[x:y]
            first, last, h, piece = first[good], last[good], h[good], piece[good]
            if not len(h):
                continue
            size = last + LENGTH - first
            # equal bytes have equal hashes: a sum of bytes times powers, moved back to power zero
            while not powers or len(powers[0]) < len(buf) + 1:
                m = max(CHUNK, len(buf)) + 1
                powers[:] = [np.cumprod(np.full(m, x, U)) for x in (ODD[0], inverse)]
            sums = np.zeros(len(buf) + 1, U)
            np.cumsum((buf.astype(U) + U(1)) * powers[0][:len(buf)], out=sums[1:])
            hashed = (sums[last + LENGTH] - sums[first]) * powers[1][first] * ODD[1] + size.astype(U) * ODD[2]
            _, one, kind = np.unique(hashed, return_index=True, return_inverse=True)
            target = ((h[one] >> U(20)) % U(buckets)).astype(np.int64)
            doc, start = rows[piece], first - starts[piece] + froms[piece]
            by_kind = np.argsort(kind, kind="stable")
            begin = np.searchsorted(kind[by_kind], np.arange(len(one) + 1))
            for k, own in _split(target):
                n = size[one[own]]
                at = np.repeat(first[one[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                times = begin[own + 1] - begin[own]
                hits = by_kind[np.repeat(begin[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                docs, doc_at = np.unique(doc[hits], return_inverse=True)
                out.append((k, _pack(
                    np.array([key[0]], np.int64), h[one[own]], n.astype(np.uint8), buf[at], times.astype(np.uint32),
                    places[docs].astype(np.uint32), ids[docs], doc_at.astype(np.uint32), start[hits].astype(np.uint32))))
        return pd.DataFrame(out, columns=["bucket", "blob"])
    return run


def _marks(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Index of a bucket's segments, and what it marks: byte ranges of the texts, by part."""
    cols: list[list[np.ndarray]] = [[] for _ in range(8)]
    n_kinds = 0
    for blob in pdf["blob"]:
        part, h, n, data, times, places, own_ids, who, at = _unpack(
            blob, np.int64, U, np.uint8, np.uint8, np.uint32, np.uint32, np.int64, np.uint32, np.uint32)
        n = n.astype(np.int64)
        m = np.zeros((len(n), WIDEST), np.uint8)
        m[np.arange(WIDEST) < n[:, None]] = data
        of_kind = np.repeat(np.arange(n_kinds, n_kinds + len(n)), times)
        n_kinds += len(n)
        for col, x in zip(cols, (h, n, m, of_kind, np.full(len(who), part[0]), places[who], own_ids[who], at.astype(np.int64)), strict=True):
            col.append(x)
    h, sizes, rows, kinds, parts, places, ids, start = (np.concatenate(x) for x in cols)
    # equal segments of several parts are one text of the index
    whole = np.ascontiguousarray(np.column_stack((rows, sizes.astype(np.uint8)))).view(f"V{WIDEST + 1}").ravel()
    _, one, same = np.unique(whole, return_index=True, return_inverse=True)
    h, sizes, rows, kinds = h[one], sizes[one], rows[one], same[kinds]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, kinds, ids)
    inside = np.arange(WINDOWS) <= (sizes - LENGTH)[:, None]
    low = np.where(inside, least[:, None], np.iinfo(np.int64).max)
    # only segments that share their anchor with another one can share a string with it
    _, group, members = np.unique(h, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(members[group] > 1)
    if len(mixed):
        index = RunIndex(rows[mixed], sizes[mixed], LENGTH)
        for texts, at, statistic in index.stream(least[mixed]):
            low[mixed[texts], at] = statistic
    highest = np.where(inside, low, np.iinfo(np.int64).min).max(axis=1)
    full = highest[kinds] < ids
    out = [(parts[full], places[full], start[full], start[full] + sizes[kinds[full]])]
    some = np.flatnonzero(~full & (low.min(axis=1)[kinds] < ids))
    for i in range(0, len(some), 1 << 16):
        part = some[i:i + (1 << 16)]
        row, col = np.nonzero((low[kinds[part]] < ids[part][:, None]) & inside[kinds[part]])
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row)) - 1
        own = part[row[a]]
        out.append((parts[own], places[own], start[own] + col[a], start[own] + col[b] + LENGTH))
    part, place, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame(
        [(p, _pack(place[at].astype(np.int64), a[at], b[at])) for p, at in _split(part)], columns=["part", "blob"])


def _cut(key, texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    found = [_unpack(x, np.int64, np.int64, np.int64) for x in marks["blob"]]
    s, a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ([], [], [])))
    order = np.lexsort((a, s))
    s, a, b = s[order], a[order], b[order]
    texts, out = _places(texts), []
    edges = np.searchsorted(s, np.arange(len(texts) + 1))
    for own, text, i, j in zip(texts["s"], texts["text"], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if i == j:
            continue
        reach = np.maximum.accumulate(b[i:j])
        new = np.flatnonzero(np.append(True, a[i + 1:j] > reach[:-1]))
        starts, ends = a[i:j][new], reach[np.append(new[1:], j - i) - 1]
        kept, at = hashlib.sha256(), 0
        for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
            kept.update(text[at:x])
            at = y
        kept.update(text[at:])
        spans = np.column_stack((starts, ends)).ravel().tolist()
        out.append((own, int((ends - starts).sum()), len(starts), kept.hexdigest(), spans))
    return pd.DataFrame(out, columns=["s", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and ``spans`` (start, end, start, end, ...) of every row."""
    last = F.lit((1 << 63) - 1)
    raw = text_of(text)
    ident = F.coalesce(F.col(key).cast("long"), last)
    h1, h2 = F.xxhash64(raw), F.xxhash64(F.lit(11), raw)
    # s names a pair of number and text; kept below 2^62 so that it divides into parts alike everywhere
    sign = lambda i: F.shiftrightunsigned(F.xxhash64(i, "h1", "h2"), 2)
    named = docs.select(F.col(key).alias("key"), ident.alias("id"), raw.alias("text"), h1.alias("h1"), h2.alias("h2"))
    named = named.withColumn("s", sign(F.col("id")))
    narrow = checkpointed(named.select(
        "key", "id", "h1", "h2", "s", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    count = lambda size: max(1, -(-int(total) // size))
    anchor_buckets, buckets, parts = count(ANCHOR_BYTES), count(SEGMENT_BYTES), count(GROUP_BYTES)
    owners = narrow.where(F.col("n_bytes") >= LENGTH).groupBy("h1", "h2").agg(F.min("id").alias("owner"))

    entries = named.select("s", "text").mapInArrow(_list_anchors(anchor_buckets, parts), _ENTRIES)
    shared = entries.groupBy("bucket").applyInPandas(_shared_anchors(parts), "part long, blob binary")
    own = owners.select(sign(F.col("owner")).alias("s")).groupBy((F.col("s") % parts).alias("part")).agg(F.collect_list("s").alias("own"))
    found = shared.select("part", "blob", F.lit(None).cast("array<bigint>").alias("own")).unionByName(
        own.select("part", F.lit(None).cast("binary").alias("blob"), "own"))
    by_part = named.where(F.octet_length("text") >= LENGTH).select(
        (F.col("s") % parts).alias("part"), "s", "id", F.col("text").cast("binary").alias("text"))
    segments = by_part.groupBy("part").cogroup(found.groupBy("part")).applyInPandas(
        _segments(anchor_buckets, buckets), "bucket long, blob binary")
    marks = segments.groupBy("bucket").applyInPandas(_marks, "part long, blob binary")
    cut = by_part.groupBy("part").cogroup(marks.groupBy("part")).applyInPandas(
        _cut, "s long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>")

    joined = narrow.join(owners, ["h1", "h2"], "left").join(cut, "s", "left")
    copy = F.col("owner") < F.col("id")
    none = F.lit(0).cast("long")
    return joined.select(
        F.col("key").alias(key), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(none, F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )
