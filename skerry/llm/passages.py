"""Repeated passages: exact substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the smallest hash of the
``m``-word groups inside it. Consecutive windows with one minimiser (a
super-k-mer) travel together as one packed string to the bucket of that
minimiser, so that equal windows meet in one bucket, and a window costs about
three words of traffic instead of ``k``. Buckets are sorted by window, and
equal hashes are confirmed byte by byte.

Before they travel, windows are compared within their chunk of the input: of
equal ones only the earliest goes on, so a passage that a third of all
documents share is at most one window a chunk in its bucket.

A minimiser that many different windows share makes a heavy bucket. No task
holds one: what goes beyond a bound is cut again by the minimisers of longer
groups under another hash, and in the last level by whole windows, and dealt
once more. Equal windows stay together at each level, so results are exact.

Rows: a null text counts as empty. A document without an id is kept whole and
takes no part. Repeated rows (one id, one text) get equal results and don't
remove each other. "Earlier" is a smaller doc_id, or the same document and an
earlier start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.textops import BLOCK, NOT_SPACE, U64, IdFilter, append, column_bytes, cut, find_words, hash_rows, hash_spans, mix64, bounded, run_starts, slices, tidy

CHUNK = 4 * BLOCK
#: Words of a group at each level of buckets; the last level's groups are whole windows.
LEVELS = 2
NAMES = ["doc_", "key_", "spans", "bucket", "blob"]
_Q = 0x5851F42D4C957F2D
_Q_INV = pow(_Q, -1, 2**64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (len - k + 1 of them)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    steps = np.full(n, U64(_Q))
    steps[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * np.multiply.accumulate(steps), out=sums[1:])
    steps = np.full(n - k + 1, U64(_Q_INV))
    steps[0] = 1
    return mix64((sums[k:] - sums[: n - k + 1]) * np.multiply.accumulate(steps))


def minimisers(words: np.ndarray, k: int, m: int, seed: int = 0) -> np.ndarray:
    """For each window of k words the smallest hash of the m-word groups inside it; each seed has hashes of its own."""
    groups = hash_rows([words[i : len(words) - m + 1 + i] for i in range(m)])
    if seed:
        groups = mix64(groups ^ U64(seed))
    width, have, low = k - m + 1, 1, groups
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    if have < width:
        n = len(groups) - width + 1
        low = np.minimum(low[:n], low[width - have : width - have + n])
    return low


def later_copies(hashes: np.ndarray, at: np.ndarray, end: np.ndarray, text: bytes, place: np.ndarray) -> np.ndarray:
    """Marks windows whose bytes text[at:end] also stand at a smaller place; windows are given in order of place."""
    order = np.argsort(hashes, kind="stable")
    heads = run_starts(hashes[order])
    sizes = np.diff(np.append(heads, len(order)))
    marked = np.zeros(len(hashes), bool)
    many = sizes > 1
    for a, n in zip(heads[many].tolist(), sizes[many].tolist(), strict=True):
        run = order[a : a + n].tolist()
        first = text[at[run[0]] : end[run[0]]]
        seen = {first: place[run[0]]}
        for i in run[1:]:
            own = text[at[i] : end[i]]
            if own == first:
                marked[i] = place[i] > seen[first]
            elif own in seen:  # another text with the same hash
                marked[i] = place[i] > seen[own]
            else:
                seen[own] = place[i]
    return marked


def _packed(*parts: np.ndarray | bytes) -> bytes:
    sizes = np.array([len(p) if isinstance(p, bytes) else p.nbytes for p in parts], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *(p if isinstance(p, bytes) else p.tobytes() for p in parts)]))


def _unpacked(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one document joined: doc, key, first start, count."""
    if not len(start):
        return doc, key, start.astype(np.int64), start.astype(np.int64)
    fresh = np.concatenate(([True], (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    first = np.flatnonzero(fresh)
    return doc[first], key[first], start[first].astype(np.int64), np.diff(np.append(first, len(start)))


class _Cutter:
    """Turns documents into packed super-k-mers."""

    def __init__(self, k: int, m: int, buckets: int):
        self.k, self.m, self.buckets = k, m, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, most=CHUNK):
                data, offsets = column_bytes(part.column("text"))
                held.append((part.column("doc_id").to_numpy(zero_copy_only=False), part.column("key").to_numpy(zero_copy_only=False), data, offsets))
                size += len(data)
                if size >= CHUNK:
                    yield from self.chunk(held)
                    held, size = [], 0
        if held:
            yield from self.chunk(held)

    def chunk(self, held) -> Iterator[pa.RecordBatch]:
        k, m = self.k, self.m
        doc, key = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order]
        where = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])[order]
        row = np.concatenate([np.arange(len(h[0])) for h in held])[order]
        texts = [held[w][2][held[w][3][r] : held[w][3][r + 1]] for w, r in zip(where.tolist(), row.tolist(), strict=True)]
        held.clear()
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        del texts
        starts, ends, first = find_words(data, offsets)
        windows = np.maximum(np.diff(first) - k + 1, 0)
        if not windows.sum():
            return
        words = hash_spans(data, starts, ends)
        # words separated by one space; no separator is needed between documents
        inside = NOT_SPACE[data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        shift = np.cumsum(~keep, dtype=np.int32)
        text = np.where(inside, data, np.uint8(32))[keep].tobytes()
        starts, ends = starts - shift[starts], ends - shift[ends - 1]
        del data, inside, keep, shift
        own = np.repeat(np.arange(len(doc)), windows)
        at = np.arange(len(own)) + np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows)  # the first word of each window
        hashes = window_hashes(words, k)[at]
        # equal places only where a row is repeated
        place = np.arange(len(own)) if len(np.unique(doc)) == len(doc) else np.unique(np.stack([doc[own], at - first[own]]), axis=1, return_inverse=True)[1].ravel()
        gone = later_copies(hashes, starts[at], ends[at + k - 1], text, place)
        del hashes, place
        if gone.any():
            g = np.flatnonzero(gone)
            yield _row(-1 - int(doc[own[g[0]]]) % 64, _packed(*_ranges(doc[own[g]], key[own[g]], at[g] - first[own[g]])))
        low = minimisers(words, k, m)
        del words
        at, own = at[~gone], own[~gone]
        if len(at):
            yield from _deal(text, starts, ends, low[at], at, doc[own], key[own], at - first[own], k, self.buckets)


def _row(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _deal(text: bytes, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, at: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows, given by their first words, joined where they follow one another and share their minimiser low;
    the packed strings go to the buckets of their minimisers."""
    fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(fresh, len(at)))
    bucket = (mix64(low[fresh]) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, fresh, count = bucket[order], fresh[order], count[order]
    a, b = starts[at[fresh]].tolist(), ends[at[fresh] + count + k - 2].tolist()
    groups = np.append(run_starts(bucket), len(bucket)).tolist()
    for i, j in zip(groups[:-1], groups[1:], strict=True):
        f = fresh[i:j]
        yield _row(int(bucket[i]), _packed(doc[f], key[f], start[f].astype(np.int32), count[i:j].astype(np.int32), b"\n".join([text[x:y] for x, y in zip(a[i:j], b[i:j], strict=True)])))


def _windows(blobs: list[bytes], k: int):
    """The windows of packed strings: text, word starts and ends, word hashes, and each window's first word, doc, key and start."""
    parts = [_unpacked(b, [np.int64, np.int64, np.int32, np.int32, np.uint8]) for b in blobs]
    doc, key, start, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
    text = b"\n".join([p[4].tobytes() for p in parts])
    del parts
    starts, ends, _ = find_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = hash_spans(np.frombuffer(text, np.uint8), starts, ends)
    count = count.astype(np.int64)
    head = np.concatenate(([0], np.cumsum(count + k - 1)[:-1]))
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    own = np.repeat(np.arange(len(doc)), count)
    return text, starts, ends, words, head[own] + step, doc[own], key[own], start[own].astype(np.int64) + step


class _Counter:
    """Sorts each bucket and returns the later copies as ranges of windows (doc_, key_, spans). Buckets of over
    ``most`` bytes are cut for the next level and handed on (bucket, blob)."""

    def __init__(self, k: int, m: int, level: int, most: int):
        self.k, self.m, self.level, self.most = k, m, level, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, size, heavy = None, [], 0, False
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = blob.as_py()
                if bucket < 0:  # found within a chunk
                    yield from self.out(*_unpacked(blob, [np.int64] * 4))
                    continue
                if bucket != now:
                    if blobs:
                        yield from self.split(blobs) if heavy else self.bucket(blobs)
                    now, blobs, size, heavy = bucket, [], 0, False
                blobs.append(blob)
                size += zstandard.frame_content_size(blob)
                if size > self.most and self.level < LEVELS:
                    yield from self.split(blobs)
                    blobs, size, heavy = [], 0, True
                elif size > self.most:  # copies of few windows: the earliest of each go on
                    rest: list[bytes] = []
                    yield from self.bucket(blobs, rest)
                    blobs, size = rest, 0
        if blobs:
            yield from self.split(blobs) if heavy else self.bucket(blobs)

    def split(self, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        text, starts, ends, words, at, doc, key, start = _windows(blobs, self.k)
        low = minimisers(words, self.k, self.m, self.level + 1)[at]
        for row in _deal(text, starts, ends, low, at, doc, key, start, self.k, 1 << 40):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *row.columns], NAMES)

    def bucket(self, blobs: list[bytes], rest: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        """rest: gets the windows that aren't later copies of the others."""
        text, starts, ends, words, at, doc, key, start = _windows(blobs, self.k)
        hashes = window_hashes(words, self.k)
        del words
        # in order of (doc, start); equal places are repeated rows
        order = np.lexsort((start, doc))
        doc, key, start, at = doc[order], key[order], start[order], at[order]
        place = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))))
        gone = later_copies(hashes[at], starts[at], ends[at + self.k - 1], text, place)
        yield from self.out(*_ranges(doc[gone], key[gone], start[gone]))
        if rest is not None:
            a = ~gone
            rest += [row.column(1)[0].as_py() for row in _deal(text, starts, ends, at[a].astype(np.uint64), at[a], doc[a], key[a], start[a], self.k, 1)]

    @staticmethod
    def out(doc, key, start, count) -> Iterator[pa.RecordBatch]:
        """One row for each document: its ranges as pairs of long."""
        if not len(doc):
            return
        order = np.lexsort((start, key, doc))
        doc, key, pairs = doc[order], key[order], np.stack([start[order], count[order]], axis=1)
        edge = np.append(np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))), len(doc))
        spans = [pairs[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
        n = len(spans)
        yield pa.RecordBatch.from_arrays([pa.array(doc[edge[:-1]]), pa.array(key[edge[:-1]]), pa.array(spans, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], NAMES)


def covered(n_words: int, spans: list[bytes], k: int) -> np.ndarray:
    """Marks the words that removed windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    for s in spans:
        pairs = np.frombuffer(s, np.int64).reshape(-1, 2)
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs[:, 0] + pairs[:, 1] + k - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated(docs: DataFrame, k: int = 20, m: int = 4, bucket: int = 8 << 20) -> DataFrame:
    """doc_, key_, found: for each document with repeated windows their ranges, to be read by covered().

    docs needs doc_id and text. key_ is xxhash64(text). bucket: the bytes of text that a bucket is sized
    for; the number of buckets follows from the text there is. A bucket of over twice that is cut again.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).where("doc_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, round(3.2 * size / bucket))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    packed = rows.mapInArrow(tidy(_Cutter(k, m, buckets)), "bucket long, blob binary")
    found = None
    for level in range(LEVELS + 1):
        group = k if level + 1 >= LEVELS else min(k, 2 * m)  # of the next level
        counter = _Counter(k, group, level, 2 * bucket)
        dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
        out = cut(dealt.mapInArrow(tidy(counter), "doc_ long, key_ long, spans binary, bucket long, blob binary"))
        ranges = out.where("spans is not null").select("doc_", "key_", "spans")
        found = ranges if found is None else found.union(ranges)
        packed = out.where("blob is not null").select("bucket", "blob")
        if level == LEVELS or packed.isEmpty():
            break
    return found.groupBy("doc_", "key_").agg(F.collect_list("spans").alias("found"))


def dedup(docs: DataFrame, k: int = 20, m: int = 4, bucket: int = 8 << 20) -> DataFrame:
    """docs with kept (the words that no removed window covers, joined by one space), n_words and n_removed.

    Columns of docs with these names are replaced; others stay as they are, whatever their names.
    """
    found = cut(repeated(docs, k, m, bucket))
    bits = IdFilter(found.select("doc_"))
    fields = "kept string, n_words long, n_removed long"
    own = [c for c in docs.columns if c.lower() not in ("kept", "n_words", "n_removed")]

    def filled(parts) -> list[pa.Array]:
        kept, n_words, n_removed = [], [], []
        for text, spans in parts:
            words = (text or b"").split()
            n_words.append(len(words))
            if spans:
                gone = covered(len(words), spans, k)
                n_removed.append(int(gone.sum()))
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]

    def texts(batch: pa.RecordBatch) -> list:
        return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()

    ids = lambda batch: batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
    plain = append(docs, fields, lambda batch: filled((t, None) for t in texts(batch)), keep=own, only=lambda batch: ~bits.may_hold(ids(batch)))
    # the others meet their ranges; all columns travel in one, so that none can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    asked = bits.rows(docs, "doc_id", True).select(F.col("doc_id").cast("long").alias("doc_"), F.xxhash64("text").alias("key_"), F.col("text").alias("text"), row.alias("row_"))
    joined = asked.join(found.hint("shuffle_hash"), ["doc_", "key_"], "left").select("text", "row_", "found")
    done = append(joined, fields, lambda batch: filled(zip(texts(batch), batch.column(batch.schema.get_field_index("found")).to_pylist(), strict=True)), keep=["row_"])
    return plain.union(done.select(*[F.col(f"row_.`{c}`") for c in own], "kept", "n_words", "n_removed"))


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
