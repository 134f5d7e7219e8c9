"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of
random signs and a Hadamard transform) and hashed to the nearest signed axis.
Each of a few tables has its own rotation. A query probes the buckets of the
axes it is nearest to, in the order of closeness over all tables; all vectors
there are ranked by their exact distance. Equal vectors are one class, with
the smallest ids it needs, so a vector that a third of all rows share costs as
much as any other.

How many buckets are probed is fitted: for at most ``SAMPLE`` queries the true
neighbours among all vectors are found, and the probes are as many as
``target`` of those neighbours need. Hashing is by direction while nearness is
Euclidean, so unequal lengths cost more probes, not recall. A query that finds
fewer than k (in a small table) is asked again with all buckets. A bucket is
dealt over as many blocks as its size asks for, and a block is read in
batches, so that memory does not grow with it.

Rows: vectors that are null, zero, or that hold null or non-finite components
take no part; neither do null ids. Vectors of different dimensions have no
distance: each dimension is searched by itself. Repeated rows count once. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.textops import cut, ragged


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


class Rotation:
    """The pseudo-rotation of a table, for vectors of dim components."""

    def __init__(self, dim: int, table: int):
        self.n = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng([11, table]).choice([-1.0, 1.0], (3, self.n))

    def axes(self, x: np.ndarray) -> np.ndarray:
        """The closeness of each row to the 2 * n signed axes."""
        y = np.zeros((len(x), self.n))
        y[:, : x.shape[1]] = x
        for s in self.signs:
            y = _hadamard(y * s)
        return np.concatenate([y, -y], axis=1)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest signed axes of each row, nearest first."""
        c = self.axes(x)
        if probes >= c.shape[1]:
            return np.argsort(-c, axis=1, kind="stable")
        if probes == 1:
            return c.argmax(axis=1)[:, None]
        return np.argsort(-c, axis=1, kind="stable")[:, :probes]


#: Queries that the number of probes is fitted on, at most; rows of a bucket beyond which it is split.
SAMPLE, BLOCK = 64, 2048


def _vectors(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _classes(every: int, dim: int, k: int, kind: str):
    def run(batches):
        for batch in batches:
            column = batch.column("v")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            ids = batch.column("id").to_numpy()
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, ids = np.ascontiguousarray(x[good]) + np.zeros(1, kind), ids[good]
            by: dict[bytes, list[int]] = {}
            for row, i in zip(x, ids.tolist(), strict=True):
                by.setdefault(row.tobytes(), []).append(i)
            own = [sorted(set(v)) for v in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array([v[: k + 1] for v in own], pa.list_(pa.int64())), pa.array([any(i % every == 0 for i in v) for v in own])], ["vec", "ids", "asks"])

    return run


class _Tables:
    """The rotations of all tables: hashes, and the order in which a query probes."""

    def __init__(self, dim: int, tables: int, kind: str):
        self.dim, self.kind = dim, kind
        self.rotations = [Rotation(dim, t) for t in range(tables)]
        self.axes = 2 * self.rotations[0].n

    def unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Of each vector the bucket in each table, numbered over all tables."""
        return np.stack([r.nearest(unit, 1)[:, 0] + t * self.axes for t, r in enumerate(self.rotations)], axis=1)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Of each query all buckets of all tables, closest first."""
        return np.argsort(-np.concatenate([r.axes(unit) for r in self.rotations], axis=1), axis=1, kind="stable")

    def sizes(self, batches):
        for batch in batches:
            n = np.bincount(self.buckets(self.unit(_vectors(batch.column("vec"), self.dim, self.kind))).ravel(), minlength=self.axes * len(self.rotations))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["bucket", "n"])

    def needs(self, sample_keys: list[int], sample: np.ndarray, k: int):
        """For each batch the k nearest of each sample query, with the number of probes that finds them."""
        place = np.argsort(self.order(self.unit(sample)), axis=1)

        def run(batches):
            for batch in batches:
                x, keys = _vectors(batch.column("vec"), self.dim, self.kind), batch.column("key").to_numpy()
                d = (sample * sample).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * sample @ x.T
                d[np.array(sample_keys)[:, None] == keys[None, :]] = np.inf
                near = np.argsort(d, axis=1)[:, :k]
                query = np.repeat(np.arange(len(sample)), near.shape[1])
                found = near.ravel()
                need = place[query[:, None], self.buckets(self.unit(x))[found]].min(axis=1) + 1
                real = np.isfinite(d[query, found])
                yield pa.RecordBatch.from_arrays([pa.array(query[real]), pa.array(d[query, found][real]), pa.array(need[real])], ["query", "dist", "need"])

        return run

    def deal(self, salts: np.ndarray, side: int, probes: int):
        """Vectors to a block of their bucket in each table (side 1), queries to all blocks of those they probe (side 0)."""

        def run(batches):
            for batch in batches:
                unit = self.unit(_vectors(batch.column("vec"), self.dim, self.kind))
                key = batch.column("key").to_numpy()
                if side:
                    bucket = self.buckets(unit)
                    row = np.repeat(np.arange(len(unit)), bucket.shape[1])
                    bucket = bucket.ravel()
                    salt = (key.view(np.uint64)[row] % salts[bucket].astype(np.uint64)).astype(np.int64)
                else:
                    near = self.order(unit)[:, :probes]
                    row, bucket = np.repeat(np.arange(len(unit)), near.shape[1]), near.ravel()
                    times = salts[bucket]
                    salt = ragged(np.zeros(len(times), np.int64), times)
                    row, bucket = np.repeat(row, times), np.repeat(bucket, times)
                for lo in range(0, len(row), 8192):
                    at = slice(lo, lo + 8192)
                    taken = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(salt[at].astype(np.int32)), pa.array(np.full(len(taken), side), pa.int32()), batch.column("key").take(taken), batch.column("vec").take(taken), batch.column("ids").take(taken)], ["bucket", "salt", "side", "key", "vec", "ids"])

        return run


def _rank(dim: int, k: int, kind: str, block: int = 4096):
    """Queries of a bucket come first, then its vectors, in batches."""

    def run(batches):
        now, q_key, q_vec = None, [], []
        best: list = []  # for each query (distance, id), k + 1 at most
        q = None
        base_vec: list[bytes] = []
        base_ids: list[list[int]] = []

        def rank():
            nonlocal base_vec, base_ids, q
            if base_vec and q_key:
                if q is None:
                    q = np.frombuffer(b"".join(q_vec), kind).reshape(-1, dim).astype(np.float64)
                x = np.frombuffer(b"".join(base_vec), kind).reshape(-1, dim).astype(np.float64)
                xx = (x * x).sum(axis=1)
                for lo in range(0, len(q), 256):
                    part = q[lo : lo + 256]
                    qq = (part * part).sum(axis=1)
                    near = qq[:, None] + xx[None, :] - 2 * part @ x.T
                    slack = 1e-9 * (qq + xx.max())
                    kth = np.partition(near, min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)]
                    for i in range(len(part)):
                        hit = np.flatnonzero(near[i] <= kth[i] + slack[i])
                        exact = np.sqrt(((x[hit] - part[i]) ** 2).sum(axis=1)).tolist()
                        found = best[lo + i] + [(d, j) for d, h in zip(exact, hit.tolist(), strict=True) for j in base_ids[h]]
                        best[lo + i] = sorted(found)[: k + 1]
            base_vec, base_ids = [], []

        def done():
            rank()
            rows = [(key, j, d) for key, found in zip(q_key, best, strict=True) for d, j in found]
            keys, ids, dist = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], ["key", "vec_id", "score"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "salt", "side", "key", "vec", "ids")]
            for bucket, salt, side, key, vec, ids in zip(*cols, strict=True):
                if (bucket, salt) != now:
                    if now is not None:
                        yield done()
                    now, q_key, q_vec, best, q = (bucket, salt), [], [], [], None
                if side == 0:
                    q_key.append(key)
                    q_vec.append(vec)
                    best.append([])
                elif q_key:
                    base_vec.append(vec)
                    base_ids.append(ids)
                    if len(base_vec) >= block:
                        rank()
        if now is not None:
            yield done()

    return run


def neighbours(vectors: DataFrame, every: int, k: int = 10, tables: int = 8, target: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``.

    vectors needs vec_id and embedding. target: the share of true neighbours that the sample queries must find.
    """
    item = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if item == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    dims = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    out = None
    for dim in dims or [1]:
        found = _of_one_dimension(rows.where(F.size("v") == dim), dim, kind, every, k, tables, target)
        out = found if out is None else out.union(found)
    return out


def fitted(classes: DataFrame, index: _Tables, k: int, target: float) -> int:
    """How many probes ``target`` of the true neighbours of the sample queries need."""
    sample = classes.where("asks").select("key", "vec").orderBy("key").limit(SAMPLE).collect()
    everything = index.axes * len(index.rotations)
    if not sample:
        return everything
    x = np.stack([np.frombuffer(r["vec"], index.kind) for r in sample]).astype(np.float64)
    near = classes.mapInArrow(index.needs([r["key"] for r in sample], x, k), "query long, dist double, need long")
    nearest = Window.partitionBy("query").orderBy("dist", "need")
    needs = sorted(r["need"] for r in near.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).select("need").collect())  # SAMPLE * k rows
    return needs[max(0, -int(-target * len(needs) // 1) - 1)] if needs else everything


def _of_one_dimension(rows: DataFrame, dim: int, kind: str, every: int, k: int, tables: int, target: float) -> DataFrame:
    found = rows.mapInArrow(_classes(every, dim, k, kind), "vec binary, ids array<long>, asks boolean").groupBy("vec")
    found = found.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    classes = cut(found.withColumn("key", F.xxhash64("vec")))
    index = _Tables(dim, tables, kind)
    probes = fitted(classes, index, k, target)
    salts = np.ones(index.axes * tables, np.int64)
    for r in classes.mapInArrow(index.sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        salts[r["bucket"]] = max(1, -(-r["n"] // BLOCK))
    dealt = "bucket int, salt int, side int, key long, vec binary, ids array<long>"
    base = classes.mapInArrow(index.deal(salts, 1, 0), dealt)

    def ask(queries: DataFrame, count: int) -> DataFrame:
        both = base.union(queries.mapInArrow(index.deal(salts, 0, count), dealt))
        ranked = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "side").mapInArrow(_rank(dim, k, kind), "key long, vec_id long, score double")
        best = Window.partitionBy("key").orderBy("score", "vec_id")
        return ranked.groupBy("key", "vec_id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)

    asking = classes.where("asks")
    top = cut(ask(asking, probes))
    few = asking.join(top.groupBy("key").agg(F.max("n").alias("n")).where(F.col("n") > k), "key", "left_anti").select("vec", "ids", "asks", "key")
    if not few.isEmpty():  # all buckets
        short = cut(few)
        top = top.join(short.select("key"), "key", "left_anti").unionByName(ask(short, index.axes * tables))
    own = rows.where(F.col("id") % every == 0).mapInArrow(_query_keys(dim, kind), "query_id long, vec binary").distinct().withColumn("key", F.xxhash64("vec")).drop("vec")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = own.join(top.select("key", "vec_id", "score"), "key").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_keys(dim: int, kind: str):
    def run(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1))
            x = np.ascontiguousarray(x) + np.zeros(1, kind)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array([x[i].tobytes() for i in good.tolist()], pa.binary())], ["query_id", "vec"])

    return run
