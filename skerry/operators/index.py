"""Indexes over DataFrames: built by shards, searched with a merge.

Vectors are dealt by a hash of their id into shards of a bounded number of
rows; each shard's graph is built in one task. A search sends blocks of
queries to all shards and keeps k rows a query and shard before the shuffle.
Nothing is broadcast that grows with the data.

An index with codes is searched among them, and what it finds is ranked anew in
full precision; a second, coarser level of codes can spare comparisons.
"""

from __future__ import annotations

import io
import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import metrics as M
from skerry.operators import builders, kernels
from skerry.operators.exact import _exact, top_k
from skerry.operators.lineage import cut
from skerry.operators.quantize import CODES, Coder

KINDS = ("vamana", "hnsw", "hcnng", "descent")


@dataclass(frozen=True)
class BuildParams:
    """Defaults: degree 64 and beam 128, alpha 1.2; for inner products alpha is 1 below 100 dimensions, else 0.98.

    codes: the quantiser whose codes searches compare (quantize.CODES), or "" for full precision; on_codes: the graph
    is built on them too (not HNSW). coarse: a second quantiser, of fewer bits, that searches filter by. normalise:
    vectors and queries are brought to unit length first. single: random edges of a single-batch Vamana build, or 0.
    """

    kind: str = "vamana"
    metric: str = "l2sq"
    degree: int = 64
    beam: int = 128
    alpha: float | None = None
    passes: int = 1
    trees: int = 10
    leaf: int = 100
    mst_degree: int = 3
    delta: float = 0.05
    shard: int = 10_000
    seed: int = 0
    codes: str = ""
    on_codes: bool = False
    coarse: str = ""
    normalise: bool = False
    single: int = 0

    def __post_init__(self):
        if self.kind not in KINDS or self.metric not in ("l2sq", "mips", "cosine"):
            raise ValueError(f"unknown kind or metric: {self.kind}, {self.metric}")
        if min(self.degree, self.beam, self.passes, self.trees, self.leaf, self.mst_degree, self.shard) < 1:
            raise ValueError("sizes must be positive")
        if self.single < 0 or (self.alpha is not None and not self.alpha > 0):
            raise ValueError("single must not be negative and alpha must be positive")
        if any(c and c not in CODES[self.metric] for c in (self.codes, self.coarse)):
            raise ValueError(f"codes of {self.metric}: {', '.join(CODES[self.metric]) or 'none'}")
        if (self.on_codes or self.coarse) and not self.codes:
            raise ValueError("on_codes and coarse need codes")
        if self.kind == "hnsw" and (self.on_codes or self.codes):
            raise ValueError("HNSW is searched in full precision")

    def pruning(self, dim: int) -> float:
        if self.alpha is not None:
            return self.alpha
        if self.metric == "mips":
            return 1.0 if dim < 100 else 0.98
        return 0.9 if self.kind == "hnsw" else 1.2


def _build(p: BuildParams, x: np.ndarray, coder: Coder | None = None):
    a, metric = p.pruning(x.shape[1] if x.ndim == 2 else 0), p.metric
    if p.on_codes:
        x, metric = coder.encode(x), coder.measure
    if p.kind == "vamana":
        return builders.vamana(x, p.degree, p.beam, a, p.passes, metric, p.seed, p.single)
    if p.kind == "hcnng":
        return builders.hcnng(x, p.trees, p.leaf, p.mst_degree, metric, p.seed)
    if p.kind == "descent":
        return builders.descent(x, p.degree, p.trees, p.leaf, a, p.delta, metric, p.seed)
    return builders.Hnsw(x, max(2, p.degree // 2), p.beam, a, None, p.metric, p.seed)


def packed(graph: list[np.ndarray] | builders.Hnsw) -> bytes:
    """A graph as plain arrays: for each layer its vertices, their degrees and all neighbours."""
    layers = graph.layers if isinstance(graph, builders.Hnsw) else [dict(enumerate(graph))]
    arrays = {"entry": np.array([graph.entry if isinstance(graph, builders.Hnsw) else -2])}
    for i, layer in enumerate(layers):
        arrays[f"vertex{i}"] = np.fromiter(layer, np.int64, len(layer))
        arrays[f"degree{i}"] = np.array([len(g) for g in layer.values()], np.int64)
        arrays[f"to{i}"] = np.concatenate([np.asarray(g, np.int64) for g in layer.values()]) if layer else np.zeros(0, np.int64)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes, x: np.ndarray, metric: str) -> list[np.ndarray] | builders.Hnsw:
    """The graph of packed(), over the vectors x. Nothing in the data is run."""
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        entry, layers = int(arrays["entry"][0]), []
        for i in range((len(arrays.files) - 1) // 3):
            parts = np.split(arrays[f"to{i}"], np.cumsum(arrays[f"degree{i}"])[:-1]) if len(arrays[f"degree{i}"]) else []
            layers.append(dict(zip(arrays[f"vertex{i}"].tolist(), parts, strict=True)))
    if entry == -2:
        return [layers[0][i] for i in range(len(layers[0]))]
    graph = builders.Hnsw.__new__(builders.Hnsw)
    graph.x, graph.metric, graph.entry, graph.visits, graph.costs = x, metric, entry, 0, 0
    graph.layers = [{v: g.tolist() for v, g in layer.items()} for layer in layers]
    return graph


class Index:
    """shards: DataFrame(shard, ids, vecs, graph) of packed arrays; coders: the fitted quantisers of the codes, finest first."""

    def __init__(self, shards: DataFrame, params: BuildParams, coders: tuple[Coder, ...] = ()):
        self.shards, self.params, self.coders = shards, params, coders

    @staticmethod
    def build(vectors: DataFrame, params: BuildParams = BuildParams()) -> Index:
        """vectors: id, vec. Built at once and written as a checkpoint, which all searches read. Rows without an id or
        a vector take no part; vectors of more than one length are an error."""
        vectors = vectors.where("id is not null and vec is not null").select("id", "vec")
        if params.normalise:
            vectors = vectors.select("id", M.normalised(F.col("vec")).alias("vec"))
        coders: tuple[Coder, ...] = ()
        if params.codes:
            few, most = vectors.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
            if few != most:
                raise ValueError("codes need vectors of one length")
            coders = tuple(Coder.fit(c, vectors, params.metric, most) for c in (params.codes, params.coarse) if c)
        n = max(1, math.ceil(vectors.count() / params.shard))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable")
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            ids = pdf["id"].to_numpy().astype(np.int64)
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "ids": [ids.tobytes()], "vecs": [x.tobytes()], "graph": [packed(_build(params, x, coders[0] if coders else None))]})

        dealt = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard"))
        # shards are small but take long: by their bytes, Spark would put many into one task
        dealt = dealt.repartition(min(4 * n, 16 * vectors.sparkSession.sparkContext.defaultParallelism), "shard")
        return Index(cut(dealt.groupBy("shard").applyInPandas(one, "shard int, ids binary, vecs binary, graph binary")), params, coders)

    def save(self, path: str) -> None:
        """Parquet, with the parameters as a one-row table beside it."""
        self.shards.write.mode("overwrite").parquet(f"{path}/shards")
        about = json.dumps(asdict(self.params)), json.dumps([asdict(c) for c in self.coders])
        self.shards.sparkSession.createDataFrame([about], "params string, coders string").write.mode("overwrite").json(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        about = spark.read.schema("params string, coders string").json(f"{path}/params").first()
        coders = tuple(Coder(**c | {"numbers": tuple(c["numbers"])}) for c in json.loads(about["coders"] or "[]"))
        return Index(spark.read.parquet(f"{path}/shards"), BuildParams(**json.loads(about["params"])), coders)

    def _each(self, queries: DataFrame, schema: str, use, many=None) -> DataFrame:
        """The columns of use(ids, x, levels, graph, qid, q) for every shard and query; levels: x in each coder's codes. many
        does the same for some hundred queries at once, or returns None. Queries travel in blocks of as many rows as a shard
        has, so that a shard is sent to Python about as often as the queries are."""
        block, metric, coders = max(512, self.params.shard), self.params.metric, self.coders
        if self.params.normalise:
            queries = queries.select("qid", M.normalised(F.col("qv")).alias("qv"))

        def blocks(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), block):
                    part = pdf.iloc[lo : lo + block]
                    yield pd.DataFrame({"qids": [part["qid"].to_numpy().astype(np.int64).tobytes()], "qvs": [np.stack(part["qv"].to_numpy()).astype(np.float64).tobytes()]})

        def run(batches):
            held = (None, None, [])
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    ids, qid = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
                    x, qs = np.frombuffer(row.vecs, np.float64).reshape(len(ids), -1), np.frombuffer(row.qvs, np.float64).reshape(len(qid), -1)
                    if held[0] != row.shard:
                        held = (row.shard, unpacked(row.graph, x, metric), [c.encode(x) for c in coders])
                    for lo in range(0, len(qid), 512):
                        told = many(ids, x, held[2], held[1], qid[lo : lo + 512], qs[lo : lo + 512]) if many else None
                        found = [told] if told else [use(ids, x, held[2], held[1], int(i), q) for i, q in zip(qid[lo : lo + 512], qs[lo : lo + 512], strict=True)]
                        yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

        return self.shards.crossJoin(queries.select("qid", "qv").mapInPandas(blocks, "qids binary, qvs binary")).mapInPandas(run, schema)

    def search(self, queries: DataFrame, k: int = 10, beam: int = 64, limit: int | None = None, degree: int | None = None, rerank: int = 1, random_start: bool = False) -> DataFrame:
        """qid, id, dist, rank, n_visited, n_cmps. queries: qid, qv.

        With codes, the search goes among them, and the k * rerank nearest found (all of the beam, if fewer) are ranked
        in full precision. random_start: a query starts at a row drawn by a hash of its id instead of the first.
        """
        if beam < k or rerank < 1:
            raise ValueError("the beam must hold k, and rerank be positive")
        if self.params.kind == "hnsw" and (limit is not None or degree is not None or random_start):
            raise ValueError("HNSW takes neither limits nor other starts")
        metric, coders = self.params.metric, self.coders

        def use(ids, x, levels, graph, qid, q):
            if isinstance(graph, builders.Hnsw):
                front = graph.search(q, k * rerank, beam)
                n_visited, cost = graph.visits, graph.costs
            else:
                start = [(qid * 2654435761 + 40503) % 2147483647 % len(ids) if random_start else 0]
                codes = [c.encode(q[None, :])[0] for c in coders]
                coarse = (lambda rows: kernels.distances(coders[1].measure, codes[1], levels[1][rows])) if len(coders) > 1 else None
                points, point, measure = (levels[0], codes[0], coders[0].measure) if coders else (x, q, metric)
                front, visited, cost = kernels.beam_search(graph, points, point, start, beam, measure, limit, degree, coarse=coarse)
                n_visited = len(visited)
            own = [i for _, i in front[: k * rerank]]
            dist = _exact(np.repeat(q[None, :], len(own), axis=0), x[own], metric)
            same = lambda v: np.full(len(own), v, np.int64)
            return {"qid": same(qid), "id": ids[own], "dist": dist, "n_visited": same(n_visited), "n_cmps": same(cost)}

        def many(ids, x, levels, graph, qid, qs):
            if isinstance(graph, builders.Hnsw) or len(coders) > 1 or len(x) > kernels.FEW:
                return None
            points, asked, measure = (levels[0], coders[0].encode(qs), coders[0].measure) if coders else (x, qs, metric)
            d = np.stack([kernels.distances(measure, q, points) for q in asked])
            if not np.isfinite(d).all():
                return None
            start = (qid * 2654435761 + 40503) % 2147483647 % len(ids) if random_start else np.zeros(len(qid), np.int64)
            order, state = kernels.beam_searches(kernels.padded(graph, degree), d, start, beam, limit)
            seen = state > 0
            i, j = np.nonzero(seen & (np.cumsum(seen, axis=1) <= min(beam, k * rerank)))
            own = order[i, j]
            return {"qid": qid[i], "id": ids[own], "dist": _exact(qs[i], x[own], metric), "n_visited": (state == 2).sum(axis=1)[i], "n_cmps": seen.sum(axis=1)[i]}

        return top_k(self._each(queries, "qid long, id long, dist double, n_visited long, n_cmps long", use, many), k)

    def search_one(self, vector: list[float], k: int = 10, beam: int = 64, **more) -> list[int]:
        """The ids nearest to one vector, nearest first."""
        one = self.shards.sparkSession.createDataFrame([(0, [float(v) for v in vector])], "qid long, qv array<double>")
        return [r["id"] for r in self.search(one, k, max(beam, k), **more).orderBy("rank").collect()]

    def range_search(self, queries: DataFrame, radius: float, beam: int = 64, mode: str = "beam", outer: float | None = None) -> DataFrame:
        """qid, id, dist: what is found within the radius. mode: beam, greedy or doubling. Always in full precision."""
        if mode not in ("beam", "greedy", "doubling"):
            raise ValueError(f"unknown mode: {mode}")
        metric = self.params.metric

        def use(ids, x, levels, graph, qid, q):
            flat = [np.array(graph.layers[0].get(i, []), int) for i in range(len(x))] if isinstance(graph, builders.Hnsw) else graph
            own = kernels.range_search(flat, x, q, radius, beam, mode, metric, outer)
            dist = _exact(np.repeat(q[None, :], len(own), axis=0), x[own], metric) if own else np.zeros(0)
            return {"qid": np.full(len(own), qid, np.int64), "id": ids[own], "dist": dist}

        return self._each(queries, "qid long, id long, dist double", use).where(F.col("dist") <= radius)

    def edges(self) -> DataFrame:
        """src, dst, rank: the graph (its lowest layer), neighbours nearest first."""

        def run(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    ids, graph = np.frombuffer(row.ids, np.int64), unpacked(row.graph, None, "")
                    lists = [np.array(graph.layers[0].get(i, []), int) for i in range(len(ids))] if isinstance(graph, builders.Hnsw) else graph
                    n = [len(g) for g in lists]
                    yield pd.DataFrame({"src": np.repeat(ids, n), "dst": ids[np.concatenate(lists)] if sum(n) else ids[:0], "rank": np.concatenate([np.arange(1, i + 1) for i in n]) if sum(n) else np.zeros(0, int)})

        return self.shards.mapInPandas(run, "src long, dst long, rank int")
