"""Exact search: all pairs, nearest neighbours and ranges.

Queries and vectors travel in blocks of a bounded number of rows and meet block
by block, as products of matrices in strips of a few MB, so that no task's
memory grows with the tables. Products only choose candidates: what is returned
is computed anew, folded in the order of the components as SQL does, and
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.lineage import cut

#: Rows of a block.
BLOCK = 2048
#: Queries of a block that meet a block of vectors at once, and pairs that are computed anew at once.
STRIP, CHUNK = 256, 1 << 14
#: Query sets of more bytes than this are not broadcast.
MOST_BROADCAST = 64 << 20
_TYPES = {"float": "<f4", "double": "<f8", "int": "<i4", "bigint": "<i8"}


def _size(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its size is known to be below MOST_BROADCAST."""
    return F.broadcast(df) if _size(df) <= MOST_BROADCAST else df


def pairs(queries: DataFrame, base: DataFrame, metric: str = "l2sq", digits: int | None = None) -> DataFrame:
    """qid, id, dist for every query and vector, rounded to ``digits``. queries: qid, qv; base: id, vec."""
    return paired(queries, base, {"dist": ("double", lambda q, x: _round(_tile(_METRIC[metric], q[0], x[0]), digits))})


def paired(queries: DataFrame, base: DataFrame, values: dict[str, tuple[str, Callable]], strip: int = 32) -> DataFrame:
    """qid, id and values of every query and vector. queries: qid and arrays; base: id and arrays. values: for each
    column its type and a function of both sides' matrices, one an array column; null where a row has no whole vector."""
    kinds = {"double": np.float64, "long": np.int64, "int": np.int32}

    def use(tiles):
        for qid, qs, q_holes, own, xs, x_holes in tiles:
            for lo in range(0, len(qid), strip):
                part = [q[lo : lo + strip] for q in qs]
                n = len(part[0])
                holes = (q_holes[lo : lo + strip, None] | x_holes[None, :]).ravel() if q_holes.any() or x_holes.any() else None
                columns = [pa.array(f(part, xs).astype(kinds[kind], copy=False).ravel(), mask=holes) for kind, f in values.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[lo : lo + strip], len(own))), pa.array(np.tile(own, n)), *columns], ["qid", "id", *values])

    return _meet(queries, base, use, "qid long, id long, " + ", ".join(f"{c} {kind}" for c, (kind, _) in values.items()), holes=True)


def top_k(scored: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """The k nearest of each query in the order (dist, id); with ties, all that equal the k-th distance."""
    order = Window.partitionBy("qid").orderBy("dist", *([] if ties else ["id"]))
    rank = F.rank() if ties else F.row_number()
    return scored.withColumn("rank", rank.over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    return blocked_knn(queries, base, k, metric)


def within(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2sq") -> DataFrame:
    return blocked_within(queries, base, radius, metric)


def non_empty(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Queries that have a result."""
    return queries.join(results.select("qid"), "qid", "left_semi")


def blocked_knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2sq", block: int = BLOCK, key: str | None = None, others: bool = False) -> DataFrame:
    """The k nearest of each query: qid, id, dist, rank. A block of queries keeps its k best of all the blocks of vectors
    its task reads, packed as one row; these are merged block by block. key: a column of both sides; only rows
    of the same value meet. others: a query doesn't find its own id. Rows without a whole vector take no part. hamming:
    of arrays of 64-bit words."""
    kind = _METRIC[metric]

    def use(tiles):
        held = None
        for qid, (q,), _, own, (x,), _ in tiles:
            if held is None or not np.array_equal(held, qid):
                if held is not None:
                    yield _flushed(held, pools)
                held, pools, bound = qid.copy(), {}, np.full(len(qid), np.inf)
            low = _Low(kind, q, x)
            for lo in range(0, len(q), STRIP):
                part = q[lo : lo + STRIP]
                limit, most = bound[lo : lo + STRIP], k + others
                hits = low.hits(lo, part, x, limit, most)
                if hits is None:
                    near, slack, sure = _near(kind, part, x)
                    if sure and len(own) > most and np.isinf(limit).any():
                        limit = np.minimum(limit, np.partition(near, most - 1, axis=1)[:, most - 1])
                    hits = _hits(kind, part, x, near, limit + slack)
                new = list(hits)
                if not sum(len(n[0]) for n in new):
                    continue
                i, d, ids = pools.get(lo, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                i, d, ids = np.concatenate([i, *(n[0] for n in new)]), np.concatenate([d, *(n[2] for n in new)]), np.concatenate([ids, *(own[n[1]] for n in new)])
                if others:
                    far = ids != qid[lo + i]
                    i, d, ids = i[far], d[far], ids[far]
                pools[lo], last, at = _best(i, d, ids, k)
                bound[lo + at] = np.where(np.isnan(last), np.inf, last)
        if held is not None:
            yield _flushed(held, pools)

    def merge(batches):
        held = None
        for batch in batches:
            for n in range(batch.num_rows):
                qid, *rest = (np.frombuffer(c[n].as_buffer(), kind) for c, kind in zip(batch.columns, ("<i8", "<i4", "<f8", "<i8")))
                if held is not None and np.array_equal(held, qid):
                    kept = [np.concatenate(v) for v in zip(kept, rest)]
                    if len(kept[0]) > 4 * k * len(qid):
                        kept = _best(*kept, k)[0]
                    continue
                if held is not None:
                    yield from _told(held, *_best(*kept, k)[0])
                held, kept = qid.copy(), [v.copy() for v in rest]
        if held is not None:
            yield from _told(held, *_best(*kept, k)[0])

    cores = queries.sparkSession.sparkContext.defaultParallelism
    # a task's bounds start anew: where all rows ask, few lanes of vectors and many of queries
    packs = _meet(queries, base, use, "q0 binary, i binary, d binary, ids binary", block, key, deal=(4 * cores, 4) if others else None)
    packs = packs.repartition(2 * cores, F.xxhash64("q0")).sortWithinPartitions("q0")
    return top_k(packs.mapInArrow(merge, "qid long, id long, dist double"), k)


def _best(i: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Of each i the k smallest (d, id), in this order; the k-th d where there is one, and whose it is."""
    order = np.lexsort((ids, d, i))
    i, d, ids = i[order], d[order], ids[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    last, few = place == k - 1, place < k
    return (i[few], d[few], ids[few]), d[last], i[last]


def _flushed(qid: np.ndarray, pools: dict) -> pa.RecordBatch:
    i, d, ids = (np.concatenate([np.zeros(0, kind), *(v[n] + (lo if n == 0 else 0) for lo, v in pools.items())]).astype(kind) for n, kind in enumerate(("<i4", "<f8", "<i8")))
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (qid, i, d, ids)], ["q0", "i", "d", "ids"])


def _told(qid: np.ndarray, i: np.ndarray, d: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids), pa.array(d)], ["qid", "id", "dist"])


class _Low:
    """Candidates of l2sq by a product in single precision, where both sides are of it, which takes half the time: with
    q.x - x.x/2 in one product, a row is one unless that is below (q.q - limit)/2 by more than the product's error."""

    def __init__(self, kind: str, q: np.ndarray, x: np.ndarray):
        self.fits = kind == "l2sq" and q.dtype == x.dtype == np.dtype("<f4") and q.shape[1] > 0
        if self.fits:
            with np.errstate(all="ignore"):
                self.qq, xx = (np.einsum("ij,ij->i", v, v, dtype=np.float64) for v in (q, x))
                most = max(self.qq.max(), xx.max())
                self.fits = bool(1e-20 < most < 1e30)  # false for NaN
                # each of the terms, and their sums, to 2**-24; twice that, and what is too small for a normal number
                self.slack = (q.shape[1] + 4) * 2.0**-23 * (np.sqrt(self.qq * xx.max()) + xx.max() / 2) + 1e-34
                if self.fits:
                    self.q = np.concatenate([q, np.ones((len(q), 1), np.float32)], axis=1)
                    self.x = np.ascontiguousarray(np.concatenate([x, (-xx / 2).astype(np.float32)[:, None]], axis=1).T)

    def hits(self, lo: int, part: np.ndarray, x: np.ndarray, limit: np.ndarray, most: int) -> Iterator | None:
        """As _hits(); None where single precision tells too little."""
        if not self.fits:
            return None
        near, qq, slack = self.q[lo : lo + len(part)] @ self.x, self.qq[lo : lo + len(part)], self.slack[lo : lo + len(part)]
        least = (qq - limit) / 2 - slack
        if len(x) > most and np.isinf(limit).any():
            least = np.maximum(least, np.partition(near, len(x) - most, axis=1)[:, len(x) - most] - 2 * slack)
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        found = _places(near >= least[:, None])
        if len(found) > near.size // 16 + 2 * most * len(part):
            return None
        return self._folded(found, part, x)

    @staticmethod
    def _folded(found: np.ndarray, part: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for lo in range(0, len(found), CHUNK):
            i, j = np.divmod(found[lo : lo + CHUNK], len(x))
            yield i, j, _exact(part[i].astype(np.float64), x[j].astype(np.float64), "l2sq")


def blocked_within(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2sq", block: int = BLOCK, later: bool = False) -> DataFrame:
    """qid, id, dist of all pairs within the radius; later: only those of qid < id. Rows without a whole vector take no part."""
    kind = _METRIC[metric]

    def use(tiles):
        for qid, (q,), _, own, (x,), _ in tiles:
            if later and qid.min() >= own.max():
                continue
            for lo in range(0, len(q), STRIP):
                near, slack, _ = _near(kind, q[lo : lo + STRIP], x)
                for i, j, d in _hits(kind, q[lo : lo + STRIP], x, near, radius + slack):
                    a, b = qid[lo + i], own[j]
                    hit = (d <= radius) & (a < b) if later else d <= radius
                    yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit]), pa.array(d[hit])], ["qid", "id", "dist"])

    return _meet(queries, base, use, "qid long, id long, dist double", block)


def _packed(df: DataFrame, block: int, key: str | None, holes: bool, parts: int) -> tuple[DataFrame, list[str]]:
    """A row for each block: the ids, each array column and which rows have no whole vector, as bytes, and the key. A
    checkpoint, as each block is read for many others."""
    first, *arrays = [c for c in df.columns if c != key]
    types = [_TYPES.get(df.schema[c].dataType.elementType.simpleString(), "<f8") for c in arrays]
    names = [f"c{n}" for n in range(len(arrays) + 2)]
    df = df.where(F.col(first).isNotNull()).select(F.col(first).cast("long"), *(F.col(c) if df.schema[c].dataType.elementType.simpleString() in _TYPES else F.col(c).cast("array<double>").alias(c) for c in arrays), *([key] if key else []))
    if key:
        df = df.where(F.col(key).isNotNull())

    def matrix(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        bad = np.zeros(len(column), bool)
        if column.null_count or column.flatten().null_count:
            bad = np.array([v is None or None in v for v in column.to_pylist()], bool)
        whole = column.filter(pa.array(~bad)) if bad.any() else column
        width = np.unique(whole.value_lengths().to_numpy())
        if len(width) > 1:
            raise ValueError("vectors of more than one length")
        x = np.zeros((len(column), int(width[0]) if len(width) else 0), kind)
        x[~bad] = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else 0
        return x, bad

    def run(batches):
        for batch in batches:
            at = {0, batch.num_rows}
            if key:
                k = batch.column(key).to_numpy(zero_copy_only=False)
                at |= set((np.flatnonzero(k[1:] != k[:-1]) + 1).tolist())
            at = sorted(at)
            for start, end in zip(at, at[1:]):
                for lo in range(start, end, block):
                    part = batch.slice(lo, min(block, end - lo))
                    told = [matrix(part.column(c), kind) for c, kind in zip(arrays, types)]
                    bad = np.logical_or.reduce([b for _, b in told])
                    rows = np.arange(part.num_rows) if holes else np.flatnonzero(~bad)
                    if len(rows):
                        values = [part.column(first).to_numpy().astype(np.int64), *(x for x, _ in told), bad]
                        row = [pa.array([v[rows].tobytes()], pa.binary()) for v in values]
                        yield pa.RecordBatch.from_arrays(row + ([part.column(key)[:1]] if key else []), names + ([key] if key else []))

    df = df.repartition(parts, *([key] if key else []), *([F.pmod(F.xxhash64(first), F.lit(parts))] if key else []))
    if key:
        df = df.sortWithinPartitions(key)
    schema = ", ".join(f"{n} binary" for n in names) + (f", {key} {dict(df.dtypes)[key]}" if key else "")
    return cut(df.mapInArrow(run, schema)), types


def _meet(queries: DataFrame, base: DataFrame, use: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK, key: str | None = None, holes: bool = False, deal: tuple[int, int] | None = None) -> DataFrame:
    """use() of the tiles of a task: qid, the queries' matrices, which rows are no whole vectors, and the same of the
    vectors. Tiles with the same queries follow each other where the vectors are the inner side of the join."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    ways = deal or (min(cores, 8), 2 * cores)
    left, q_types = _packed(queries, block, key, holes, ways[0])
    right, x_types = _packed(base, block, key, holes, ways[1])

    def side(columns, n, types):
        ids, *rest = (c[n].as_buffer() for c in columns)
        ids = np.frombuffer(ids, np.int64)
        return ids, [np.frombuffer(b, kind).reshape(len(ids), -1) for b, kind in zip(rest, types)], np.frombuffer(rest[-1], bool)

    def run(batches):
        def tiles():
            for batch in batches:
                for n in range(batch.num_rows):
                    yield *side(batch.columns[: len(q_types) + 2], n, q_types), *side(batch.columns[len(q_types) + 2 :], n, x_types)

        return use(tiles())

    left = left.select(*(F.col(f"c{n}").alias(f"q{n}") for n in range(len(q_types) + 2)), *([key] if key else []))
    if key:  # the vectors of a key are dealt to lanes, and its queries meet each
        left = left.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(cores - 1))))
        right = right.withColumn("lane", F.pmod(F.xxhash64("c0"), F.lit(cores)).cast("int"))
    both = left.join(right, [key, "lane"]) if key else left.crossJoin(right)
    return both.select(*(f"q{n}" for n in range(len(q_types) + 2)), *(f"c{n}" for n in range(len(x_types) + 2))).mapInArrow(run, schema)


_METRIC = {"l2sq": "l2sq", "euclidean": "l2sq", "mips": "mips", "cosine": "cosine", "hamming": "hamming"}


def _signs(words: np.ndarray) -> np.ndarray:
    """Bits of 64-bit words as 1 and -1."""
    return np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _near(kind: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distances by a product, how far each query's may be from the folded ones, and whether all are numbers. What is
    none becomes minus infinity, to be computed anew."""
    if kind == "hamming":
        a, b = _signs(q), _signs(x)
        return (a.shape[1] - (a @ b.T).astype(np.float64)) / 2, np.zeros(len(q)), True
    q, x = q.astype(np.float64), x.astype(np.float64)
    with np.errstate(all="ignore"):
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        share = (10 * q.shape[1] + 40) * 1.2e-16
        if kind == "l2sq":
            near = q @ x.T
            near *= -2
            near += qq[:, None]
            near += xx
            slack = share * (qq + xx.max())
        elif kind == "mips":
            near = -(q @ x.T)
            slack = share * np.sqrt(qq * xx.max())
        else:
            near = 1 - (q / np.sqrt(qq)[:, None]) @ (x / np.sqrt(xx)[:, None]).T
            slack = np.full(len(q), share)
        most, least = np.maximum(qq.max(), xx.max()), np.minimum(qq.min(), xx.min())
        sure = bool(most < 1e150 and (least > 1e-150 if kind == "cosine" else True))  # false for NaN
        if not sure:
            near[:] = -np.inf
            slack = np.zeros(len(q))
        return near, slack + 1e-300, sure


def _places(hit: np.ndarray) -> np.ndarray:
    """flatnonzero() of booleans of which few are true: by eights first."""
    if hit.size % 8:
        return np.flatnonzero(hit)
    at = np.flatnonzero(hit.ravel().view(np.uint64))
    i, j = np.nonzero(hit.reshape(-1, 8)[at])
    return at[i] * 8 + j


def _hits(kind: str, q: np.ndarray, x: np.ndarray, near: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances, in chunks, of the pairs that may lie within each query's limit."""
    found = _places(near <= np.broadcast_to(limit, len(q))[:, None])
    for lo in range(0, len(found), CHUNK):
        i, j = np.divmod(found[lo : lo + CHUNK], len(x))
        yield i, j, near[i, j] if kind == "hamming" else _exact(q[i].astype(np.float64), x[j].astype(np.float64), kind)


def _tile(kind: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all pairs, folded in the order of the components."""
    if kind == "hamming":
        return _near(kind, q, x)[0]
    q, across = q.astype(np.float64), np.ascontiguousarray(x.T, np.float64)
    total, step = np.zeros((len(q), across.shape[1])), np.empty((len(q), across.shape[1]))
    with np.errstate(all="ignore"):
        for a, b in zip(q.T, across):
            if kind == "l2sq":
                np.subtract(a[:, None], b, out=step)
                np.multiply(step, step, out=step)
            else:
                np.multiply(a[:, None], b, out=step)
            total += step
        if kind == "cosine":
            fold = lambda v: np.sqrt(np.cumsum(v * v, axis=0)[-1])
            return 1 - total / (fold(q.T)[:, None] * fold(across))
    return -total if kind == "mips" else total


def _round(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves away from zero, as round() of SQL does."""
    if digits is None:
        return x
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        y = np.abs(x) * scale
        whole = np.floor(y)
        whole += y - whole >= 0.5
        return np.where(np.isfinite(y), np.copysign(whole / scale, x), x) + 0.0


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Folded in the order of the components, as SQL does."""
    fold = lambda x: np.cumsum(x, axis=1)[:, -1]
    with np.errstate(all="ignore"):
        if metric == "mips":
            return -fold(a * b)
        if metric == "cosine":
            return 1 - fold(a * b) / (np.sqrt(fold(a * a)) * np.sqrt(fold(b * b)))
        return fold((a - b) * (a - b))
