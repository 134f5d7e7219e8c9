"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Lengths are integers up to the sequence size, so the packing is decided on the
histogram of lengths alone, which is all that the driver sees (``size``
numbers, whatever the corpus). A bin is filled greedily with the longest piece
that fits; then its smallest piece is replaced by two unpacked ones if they
fill the widened gap more tightly. A bin's pattern is repeated as often as the
histogram allows. Each piece finds its bin by its rank among the pieces of its
length: the rank is local to a partition plus the counts of the partitions
before it.

Rows: a null text counts as empty and is one piece that holds the end token.
Repeated rows are packed as often as they occur. A null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.bpe import encoder
from skerry.llm.textops import BLOCK, bounded, column_bytes, cut, slices, tidy


def best_two_fit(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs counts[n] pieces of each length n into bins: (bins, [(length, pieces of it in each bin)])."""
    counts = counts.astype(np.int64).copy()
    patterns = []
    while counts.any():
        left, gap, inside = counts.copy(), size, Counter()
        fits = _largest(left)
        while gap and (n := fits[gap]):
            use = int(min(left[n], gap // n))
            inside[n] += use
            left[n] -= use
            gap -= use * n
            if not left[n]:
                fits = _largest(left)
        if gap and len(inside) + max(inside.values()) > 2:  # never give up the piece that opened the bin
            small = min(inside)
            left[small] += 1
            room, best, pair = gap + small, small, None
            fits = _largest(left)
            for a in np.flatnonzero(left[: room + 1])[::-1].tolist():
                if 2 * a < best:
                    break
                b = int(fits[min(a, room - a)])
                if b == a and left[a] < 2:
                    left[a] -= 1
                    b = int(_largest(left)[min(a, room - a)])
                    left[a] += 1
                if b and a + b > best:
                    best, pair = a + b, (a, b)
            if pair:
                inside[small] -= 1
                inside.update(pair)
        pattern = sorted(((n, u) for n, u in inside.items() if u), reverse=True)
        times = min(int(counts[n]) // u for n, u in pattern)
        for n, u in pattern:
            counts[n] -= times * u
        patterns.append((times, pattern))
    return patterns


def _largest(counts: np.ndarray) -> np.ndarray:
    """For each x the largest length up to x of which there are pieces, or 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, pieces in each bin, first bin, offset in the bin), in order of rank."""
    out: dict[int, list] = {}
    rank: Counter = Counter()
    first = 0
    for times, pattern in patterns:
        offset = 0
        for n, u in pattern:
            out.setdefault(n, []).append((rank[n], u, first, offset))
            rank[n] += times * u
            offset += n * u
        first += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _cut_pieces(path: str, size: int, end: int):
    def run(batches):
        encode, seen, pid = encoder(path, "merge"), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, most=2 * BLOCK):
                ids, edges = encode(*column_bytes(part.column("text")))
                rows: list[tuple] = []
                for i, (doc, a, b) in enumerate(zip(part.column("doc_id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    n = len(own)
                    at = 0
                    for k in range(-(-n // size)):
                        to = n - size * (-(-n // size) - 1 - k)
                        seen[to - at] += 1
                        rows.append((doc, k, at, to - at, zlib.crc32(own[at:to].tobytes()), pid, int(seen[to - at]) - 1))
                        at = to
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of a document.

    A document is the ids of its text and then ``end``; longer ones are cut into pieces of ``size`` ids, of
    which the first may be shorter. path: the vocabulary file.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(rows.mapInArrow(tidy(_cut_pieces(path, size, end), "bpe"), "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"))
    counts = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[row["length"]] = row["n"]
    table = slots(best_two_fit(histogram, size))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                i = np.flatnonzero(length == n)
                t = table[n]
                s = t[np.searchsorted(t[:, 0], rank[i], "right") - 1]
                k = rank[i] - s[:, 0]
                seq[i], off[i] = s[:, 2] + k // s[:, 1], s[:, 3] + k % s[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(offsets, ["pid", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
