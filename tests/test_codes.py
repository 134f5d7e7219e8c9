"""Quantised vectors: codes, searches among them, and the harness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import metrics
from skerry.operators import evaluate, exact, graph, kernels, quantize
from skerry.operators.index import BuildParams, Index
from skerry.plans import coding

DIM = 70  # of more than one word


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(5).normal(0, 1, (300, DIM))
    x[7] = 0.0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()


@pytest.fixture(scope="module")
def spread(spark):
    """Without the zero row: nearer to all others than they are to each other, it would stand in the way of every edge."""
    x = np.random.default_rng(5).normal(0, 1, (300, DIM))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()


def truth(x, q, k):
    d = ((x - q) ** 2).sum(1)
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


def asked(df, most=20):
    return df.where(f"id < {most}").select(F.col("id").alias("qid"), F.col("vec").alias("qv"))


def test_arrays_and_columns_have_the_same_codes(table):
    x, df = table
    kinds = [quantize.Scalar.fit(df), quantize.Scalar.fit(df, 16), quantize.Symmetric.fit(df, 4), quantize.Symmetric.fit(df, 8, trim=True), quantize.Ternary.fit(df)]
    words = [quantize.Bits.fit_median(df), quantize.SparseSketch.draw(DIM), quantize.SparseSketch.draw(DIM, 130, 5, True)]
    columns = [q.transform(F.col("vec")) for q in kinds] + [words[0].transform(F.col("vec"), DIM)] + [q.transform(F.col("vec")) for q in words[1:]]
    rows = df.select("id", *(c.alias(f"c{i}") for i, c in enumerate(columns))).orderBy("id").collect()
    for i, q in enumerate(kinds + words):
        want = q.encode(x)
        assert want.tolist() == [list(map(int, r[f"c{i}"])) for r in rows] if i < 5 else want.view("<i8").tolist() == [list(r[f"c{i}"]) for r in rows]


def test_dense_sketches(table):
    x, _ = table
    sketch = quantize.DenseSketch(DIM)
    assert (sketch.bits(x).view("<u8")[:, 0] & 1).tolist() == (x @ sketch.matrix[:, 0] > 0).astype(int).tolist()
    codes = sketch.bytes(x)
    assert codes.dtype == np.int8 and not codes[7].any() and sketch.project(x).shape == (300, 128)


def test_normalised_keeps_zero(table):
    x, df = table
    rows = df.select("id", metrics.normalised(F.col("vec")).alias("v")).orderBy("id").collect()
    assert not any(rows[7].v) and np.allclose(rows[8].v, x[8] / np.linalg.norm(x[8]))


def test_hamming_of_words():
    a = np.array([[0b1011, 1 << 63], [0, 0]], np.uint64)
    assert kernels.distances("hamming", a[1], a).tolist() == [4.0, 0.0]


def test_a_coarse_level_spares_comparisons():
    """On a random graph most neighbours are far; on codes as fine as the distances themselves none that matters is lost."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 3))
    wide = [rng.choice(300, 40, replace=False) for _ in range(300)]
    q = x[9] + 0.01
    plain, _, cost = kernels.beam_search(wide, x, q, [0], 10)
    front, _, fewer = kernels.beam_search(wide, x, q, [0], 10, coarse=lambda rows: kernels.distances("l2sq", q, x[rows]))
    assert front[0] == plain[0] and front[0][1] == 9 and fewer < cost
    full = [np.array([1, 2]), np.array([3]), np.array([0]), np.array([0])]
    y = np.array([[1.0], [2.0], [3.0], [1.5]])
    seen = []
    coarse = lambda r: seen.append(list(r)) or np.array([{0: 1.0, 1: 3.0, 2: 9.0, 3: 2.5}[i] for i in r])
    front, visited, n = kernels.beam_search(full, y, np.array([0.0]), [0], 2, coarse=coarse)
    # the frontier is full with rows 0 and 1, whose mean is 2: row 3, at 2.5, isn't compared
    assert [i for _, i in front] == [0, 1] and n == 3 and seen[:2] == [[0, 1], [3]]


def scanned(index, y, q, n):
    """The n rows nearest among the codes, by a scan of all, in the order of full precision."""
    coder = index.coders[0]
    d = kernels.distances(coder.measure, coder.encode(q[None])[0], coder.encode(y))
    own = np.lexsort((np.arange(len(y)), d))[:n]
    full = kernels.distances(index.params.metric, q, y[own])
    return own[np.lexsort((own, full))][:5].tolist()


@pytest.mark.parametrize(("codes", "coarse", "rerank"), [("16", "", 1), ("8", "", 2), ("16", "8", 2), ("bits", "", 12), ("sketch", "", 6)])
def test_searches_among_codes(spread, tmp_path, spark, codes, coarse, rerank):
    x, df = spread
    index = Index.build(df, BuildParams(degree=24, beam=48, codes=codes, coarse=coarse))
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.coders == index.coders and again.params == index.params
    rows = again.search(asked(df), 5, 200, rerank=rerank).collect()
    assert len(rows) == 100
    for r in rows:
        assert r.dist == pytest.approx(((x[r.qid] - x[r.id]) ** 2).sum())
    assert sum(r.id in scanned(index, x, x[r.qid], 5 * rerank) for r in rows) >= 90
    if codes in ("8", "16"):
        assert sum(r.id in truth(x, x[r.qid], 5) for r in rows) >= 90


@pytest.mark.parametrize(("codes", "rerank"), [("8", 2), ("4", 4), ("ternary", 6), ("dense8", 12)])
def test_inner_products_among_codes(spread, codes, rerank):
    x, df = spread
    index = Index.build(df, BuildParams(metric="mips", degree=24, beam=48, codes=codes, on_codes=codes != "dense8", normalise=True))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = index.search(asked(df), 5, 200, rerank=rerank).collect()
    assert len(rows) == 100 and all(r.dist == pytest.approx(-(y[r.qid] @ y[r.id])) for r in rows)
    assert sum(r.id in scanned(index, y, y[r.qid], 5 * rerank) for r in rows) >= 85


def test_single_batch_and_random_starts(spread):
    x, df = spread
    index = Index.build(df, BuildParams(degree=16, beam=32, passes=2, single=6, shard=200))
    rows = index.search(asked(df), 5, 60, random_start=True).collect()
    assert sum(r.id in truth(x, x[r.qid], 5) for r in rows) >= 90
    assert index.search_one(x[3].tolist(), 3, 60)[0] == 3


@pytest.mark.parametrize("wrong", [{"codes": "5"}, {"coarse": "8"}, {"on_codes": True}, {"kind": "hnsw", "codes": "8"}, {"metric": "cosine", "codes": "8"}, {"single": -1}, {"alpha": 0.0}, {"degree": 0}])
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        BuildParams(**wrong)


def test_codes_by_metric_and_dimension():
    assert coding("l2sq", 128) == {"codes": "8"} and coding("l2sq", 960)["coarse"] == "sketch"
    assert coding("mips", 300) == {"codes": "8", "normalise": True, "coarse": "ternary"} and coding("l2sq", 128, False) == {}
    BuildParams(metric="mips", **coding("mips", 300))


def test_harness(spread, tmp_path, spark):
    _, df = spread
    index = Index.build(df, BuildParams(degree=16, beam=32))
    near = exact.blocked_knn(asked(df), df, 20)
    grid = evaluate.sweep(spark, 10, 16).where("k = 10 and (visit_limit = 12 or visit_limit is null and beam in (10, 100))")
    found = evaluate.measure(index, asked(df), near, grid)
    rows = found.orderBy("beam", "visit_limit").collect()
    assert len(rows) == 3 and rows[-1].recall == 1.0 and rows[-1].tail_cmps >= rows[-1].avg_cmps > 0 and min(r.qps for r in rows) > 0
    for _ in range(2):
        evaluate.append_results(found, str(tmp_path / "csv"), "path", "R=16")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 2 * evaluate.frontier(found).count() and back.columns[:4] == ["graph", "parameters", "num_queries", "target_recall"]
    with pytest.raises(ValueError):
        evaluate.measure(index, asked(df), near.where("rank <= 5"), grid)
    ranges = evaluate.measure_ranges(index, asked(df), exact.within(asked(df), df, 110.0).select("qid", "id"), 110.0, beams=(10, 200)).orderBy("beam").collect()
    assert 0 < ranges[0].cumulative <= ranges[1].cumulative and ranges[1].cumulative >= 0.99


def test_prune_as_the_kernel_does(table):
    x, df = table
    near = exact.blocked_knn(asked(df), df, 25).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    got = {}
    for r in graph.prune(near.union(near), df, 1.1, 6).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    for p in range(20):
        c = [(float(((x[p] - x[i]) ** 2).sum()), i) for i in truth(x, x[p], 25)]
        assert got[p] == kernels.robust_prune(p, c, x, 1.1, 6)
    assert graph.prune(near.limit(0), df, 1.1, 6).count() == 0


def test_flood_and_reach_end(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "src long, dst long")
    allowed = spark.createDataFrame([(9, 0), (9, 1), (9, 3), (8, 0)], "qid long, id long")
    starts = spark.createDataFrame([(9, 0), (9, 5)], "qid long, id long")
    assert {tuple(r) for r in graph.flood(edges, allowed, starts).collect()} == {(9, 0), (9, 1)}
    r = graph.reach(edges, spark.range(7), 0).first()
    assert tuple(r) == (7, 3, 4, 1)
