"""Language-model scores by deleted interpolation.

log10 p(w | v) mixes the maximum-likelihood estimates of the bigram and the
unigram with a uniform one. The weights depend on how often the context v was
seen (buckets of powers of two) and are learned by expectation-maximisation on
held-out counts: a fifth of the training documents is deleted from the counts,
and the weights are those that predict it best. For that the deleted counts are
put in cells by quarter powers of two of both estimates, each with its mean
estimates, so that the weights are those of a histogram of fixed size and
approximate those of single counts. The final counts are those of all training
documents.

Documents are grouped into chunks, whose tokens become numbers into the
chunk's own word list (the state). A chunk asks for its distinct words and
bigrams only, as sorted 64-bit hashes dealt over buckets that count them over
the whole corpus and answer in the order asked. Every n-gram of the corpus is
counted; nothing is capped. A word in a third of all documents is asked for
once a chunk. To the driver go three totals and a histogram of fixed size.

Rows: a null text counts as empty, which is one end token. A null doc_id is
scored and counts as the text "null" for the split. Repeated rows count as
often as they occur. A text of any length is one chunk at most and is scored
whole. An empty table gives an empty one; other columns are not returned.

A chunk sends a blob to each bucket that one of its n-grams falls in, so there
are never more blobs than distinct n-grams of all chunks; far beyond a
terabyte blobs get as small as that.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.textops import BLOCK, LOWER, U64, bounded, column_bytes, cut, find_words, hash_rows, hash_spans, ragged, slices, tidy

END = U64(0xE0D0C0B0A0908070)
CHUNK = 12 * BLOCK
#: Cells of the histogram for expectation-maximisation: context buckets, and steps of the two estimates in log2 / 4.
CONTEXTS, STEPS, FINE = 40, 160, 4


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Sorted hashes as byte planes of their differences, which compress well."""
    d = np.diff(x, prepend=U64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).ravel()


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _columns(x: np.ndarray) -> np.ndarray:
    """Whole numbers as byte planes: counts are small, so that most planes are zeros."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).ravel()


def _uncolumns(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


class _States:
    """Documents to states: doc ids, parts of the split, tokens as numbers into the chunk's words by frequency."""

    def __call__(self, batches):
        held, size, serial = [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, most=CHUNK):
                data, offsets = column_bytes(part.column("text"))
                data = LOWER[data]
                starts, ends, first = find_words(data, offsets)
                held.append((part.column("doc_id").to_pylist(), hash_spans(data, starts, ends), np.diff(first)))
                size += len(data)
                if size >= CHUNK:
                    yield self.chunk(task << 32 | serial, held)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield self.chunk(task << 32 | serial, held)

    def chunk(self, number: int, held: list) -> pa.RecordBatch:
        ids = [i for h in held for i in h[0]]
        counts = np.concatenate([h[2] for h in held])
        words = np.concatenate([h[1] for h in held])
        tokens = np.full(len(words) + len(ids), END)  # each document's words, then one end
        edge = np.concatenate(([0], np.cumsum(counts + 1)))
        tokens[ragged(edge[:-1], counts)] = words
        known, tokens, often = np.unique(tokens, return_inverse=True, return_counts=True)
        by_count = np.argsort(-often, kind="stable")  # frequent words get small numbers, which compress better
        number_of = np.empty(len(known), np.int64)
        number_of[by_count] = np.arange(len(known))
        crc = np.array([zlib.crc32(("null" if i is None else str(i)).encode()) for i in ids], np.int64)
        part = np.where(crc % 5 == 1, 2, np.where(crc // 5 % 5 == 1, 1, 0)).astype(np.uint8)  # 2: held out, 1: deleted, 0: kept
        blob = _pack(np.array([i is None for i in ids]), np.array([i or 0 for i in ids], np.int64), part, (counts + 1).astype(np.int64), _planes(known), _columns(np.diff(by_count, prepend=0)), _columns(number_of[tokens]))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "bucket", "blob"])


class _State:
    def __init__(self, blob: bytes):
        none, ids, self.part, self.sizes, known, by_count, tokens = _unpack(blob, [np.bool_, np.int64, np.uint8, np.int64, np.uint8, np.uint8, np.uint8])
        self.ids = pa.array(ids, mask=none)
        self.known, self.tokens = _unplaned(known), np.cumsum(_uncolumns(by_count))[_uncolumns(tokens)]
        self.edge = np.concatenate(([0], np.cumsum(self.sizes)))
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.edge[:-1]] = int(np.searchsorted(self.known, END))  # an end stands before each document
        keys = hash_rows([self.known[self.before], self.known[self.tokens]])
        self.pairs, at, self.pair = np.unique(keys, return_index=True, return_inverse=True)
        self.pair_before, self.pair_word = self.before[at], self.tokens[at]
        self.token_part = np.repeat(self.part, self.sizes)

    def counts(self, numbers: np.ndarray, n: int, part: int) -> np.ndarray:
        return np.bincount(numbers[self.token_part == part], minlength=n)


def _ask(buckets: int):
    """From a state, for each bucket: word hashes and pair hashes, each with its kept and deleted counts here."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                s = _State(blob)
                word = [s.counts(s.tokens, len(s.known), p) for p in (0, 1)]
                pair = [s.counts(s.pair, len(s.pairs), p) for p in (0, 1)]
                # buckets are ranges of hashes, so that the sorted lists are cut
                edge = np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)
                w = np.concatenate(([0], np.searchsorted(s.known, edge.astype(np.uint64)), [len(s.known)]))
                p = np.concatenate(([0], np.searchsorted(s.pairs, edge.astype(np.uint64)), [len(s.pairs)]))
                out = [_pack(_planes(s.known[a:b]), _columns(word[0][a:b]), _columns(word[1][a:b]), _planes(s.pairs[c:d]), _columns(pair[0][c:d]), _columns(pair[1][c:d])) for a, b, c, d in zip(w[:-1], w[1:], p[:-1], p[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * buckets, pa.int64()), pa.array(range(buckets), pa.int32()), pa.array(out, pa.binary())], ["chunk", "bucket", "blob"])

    return run


def _answer(batches):
    """Counts of a bucket over all chunks; answers to each in its order, and the bucket's totals (chunk -1)."""

    def one(hashes: list[np.ndarray], kept: list[np.ndarray], deleted: list[np.ndarray]):
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = [np.bincount(inverse, np.concatenate(c).astype(np.float64), len(distinct)).astype(np.int64) for c in (kept, deleted)]
        edges = np.cumsum([0, *map(len, hashes)])
        return total, [(total[0][inverse[a:b]], total[1][inverse[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def bucket(number: int, chunks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_unpack(b, [np.uint8] * 6) for b in blobs]
        words, word = one([_unplaned(p[0]) for p in parts], [_uncolumns(p[1]) for p in parts], [_uncolumns(p[2]) for p in parts])
        _, pair = one([_unplaned(p[3]) for p in parts], [_uncolumns(p[4]) for p in parts], [_uncolumns(p[5]) for p in parts])
        out = [_pack(*map(_columns, (*w, *p))) for w, p in zip(word, pair, strict=True)]
        seen = words[0] + words[1]
        out.append(np.array([words[0].sum(), words[1].sum(), (words[0] > 0).sum(), (seen > 0).sum()], np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([*chunks, -1], pa.int64()), pa.array([number] * len(out), pa.int32()), pa.array(out, pa.binary())], ["chunk", "bucket", "blob"])

    now, chunks, blobs = None, [], []
    for batch in batches:
        for chunk, b, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "blob")), strict=True):
            if b != now and blobs:
                yield bucket(now, chunks, blobs)
                chunks, blobs = [], []
            now = b
            chunks.append(chunk)
            blobs.append(blob)
    if blobs:
        yield bucket(now, chunks, blobs)


def _meet(use):
    """Joins each chunk's state (bucket -1 comes first) with its answers and hands both to use."""

    def run(batches):
        now, state, answers = None, None, []

        def done():
            parts = [[_uncolumns(x) for x in _unpack(b, [np.uint8] * 4)] for b in answers]
            return use(_State(state), *(np.concatenate([p[i] for p in parts]) for i in range(4)))

        for batch in batches:
            for chunk, b, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "blob")), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, state, answers = chunk, None, []
                if b < 0:
                    state = blob
                else:
                    answers.append(blob)
        if now is not None:
            yield done()

    return run


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(counts > 0, np.minimum(CONTEXTS - 1, 1 + np.log2(np.maximum(counts, 1)).astype(np.int64)), 0)


def _histogram(n: int):
    """How often the deleted part has each (context bucket, unigram estimate, bigram estimate), with mean estimates."""

    def use(s: _State, word_kept, word_deleted, pair_kept, pair_deleted):
        d = s.counts(s.pair, len(s.pairs), 1)
        own = np.flatnonzero(d)
        d, c = d[own].astype(np.float64), word_kept[s.pair_before[own]]
        one = word_kept[s.pair_word[own]] / max(n, 1)
        two = np.where(c > 0, pair_kept[own] / np.maximum(c, 1), 0.0)
        step = lambda p: np.where(p > 0, np.minimum(STEPS - 1, 1 + (-np.log2(np.maximum(p, 1e-300)) * FINE).astype(np.int64)), 0)
        cell = (context_bucket(c) * STEPS + step(one)) * STEPS + step(two)
        cells, inverse = np.unique(cell, return_inverse=True)
        sums = [np.bincount(inverse, w, len(cells)) for w in (d, d * one, d * two)]
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array(x, pa.float64()) for x in sums)], ["cell", "d", "one", "two"])

    return use


def learn_weights(cells: np.ndarray, d: np.ndarray, one: np.ndarray, two: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket, by expectation-maximisation."""
    out = np.tile([0.3, 0.6, 0.1], (CONTEXTS, 1))
    out[0] = [0.0, 0.9, 0.1]
    bucket = cells // (STEPS * STEPS)
    start = np.ones(3)
    for b in range(CONTEXTS):
        i = bucket == b
        p = np.stack([two[i], one[i], np.full(int(i.sum()), uniform)], axis=1)
        w = out[b].copy()
        for _ in range(rounds):
            share = p * w
            total = share.sum(axis=1, keepdims=True)
            got = (d[i, None] * share / np.maximum(total, 1e-300)).sum(axis=0) + 0.01 * start * out[b]  # a little of the start keeps empty buckets defined
            w = got / got.sum()
        out[b] = np.maximum(w, [0.0, 1e-6, 1e-6])
        out[b] /= out[b].sum()
    return out


def _scores(n: int, v: int, weights: np.ndarray):
    def use(s: _State, word_kept, word_deleted, pair_kept, pair_deleted):
        c = word_kept + word_deleted
        pair = pair_kept + pair_deleted
        before = c[s.pair_before]
        w = weights[context_bucket(before)]
        p = w[:, 0] * np.where(before > 0, pair / np.maximum(before, 1), 0.0) + w[:, 1] * c[s.pair_word] / max(n, 1) + w[:, 2] / (v + 1)
        token = lambda x, numbers: np.add.reduceat(x[numbers], s.edge[:-1])
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        cols = [s.ids, pa.array(s.part == 2), pa.array(s.sizes), pa.array(token((c > 0).astype(np.int64), s.tokens)), pa.array(np.full(len(s.sizes), n, np.int64)), pa.array(token(base, s.tokens)), pa.array(token(np.log10(p), s.pair))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return use


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Documents whose crc32(doc_id as text) mod 5 is 1 are held out: scored, but never learned from.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "chunk long, bucket int, blob binary"
    states = cut(rows.mapInArrow(tidy(_States()), kind))
    n_chunks = states.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8, n_chunks // 2)
    asked = states.mapInArrow(tidy(_ask(buckets)), kind).repartition(min(buckets, max(parts, buckets // 4)), "bucket").sortWithinPartitions("bucket", "chunk")
    answers = cut(asked.mapInArrow(tidy(_answer), kind))  # what was asked is gone before states and answers meet
    met = cut(states.union(answers).repartition(max(parts, n_chunks // 4), "chunk").sortWithinPartitions("chunk", "bucket"))
    totals = met.where("chunk = -1").select("blob").mapInArrow(_add_totals, "kept long, deleted long, v_kept long, v long").groupBy().agg(*[F.sum(c).alias(c) for c in ("kept", "deleted", "v_kept", "v")]).first()
    kept, deleted, v_kept, v = (int(x or 0) for x in totals)
    own = met.where("chunk >= 0")
    cells = own.mapInArrow(tidy(_meet(_histogram(kept))), "cell long, d double, one double, two double").groupBy("cell").agg(F.sum("d").alias("d"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    found = cells.orderBy("cell").toArrow()  # at most CONTEXTS * STEPS ** 2 rows
    d = found.column("d").to_numpy()
    weights = learn_weights(found.column("cell").to_numpy(), d, found.column("one").to_numpy() / np.maximum(d, 1e-300), found.column("two").to_numpy() / np.maximum(d, 1e-300), 1 / (v_kept + 1))
    return own.mapInArrow(tidy(_meet(_scores(kept + deleted, v, weights))), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _add_totals(batches):
    for batch in batches:
        sums = np.sum([np.frombuffer(b, np.int64) for b in batch.column("blob").to_pylist()] or [np.zeros(4, np.int64)], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], ["kept", "deleted", "v_kept", "v"])
