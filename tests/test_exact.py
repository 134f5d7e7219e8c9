"""Blocks of queries and vectors against plain sums."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import catalog
from skerry.operators import exact


def table(spark, x, kind="double", first="id", name="vec"):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{first} long, {name} array<{kind}>")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["d1_l2sq_pairs", "d5_mips_pairs", "d13_cosine_pairs", "d6_code_dot", "ex1_knn_l2", "ex1_knn_mips", "ex2_range", "snk5_nonempty", "ex4_leaf_knn", "ev4_range_recall"])
def test_pairs_are_not_folded_one_by_one(spark, sf, name):
    assert "MapInArrow" in plan(df := catalog.QUERIES[name](spark, sf)) and not [line for line in plan(df).splitlines() if "Join" in line and "aggregate(" in line]


@pytest.mark.parametrize("metric", ["l2sq", "mips", "cosine"])
def test_rows_without_a_whole_vector(spark, metric):
    x = [*np.random.default_rng(1).normal(0, 1, (40, 5))]
    x[3] = x[17] = None
    df = table(spark, x)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    rows = exact.pairs(q, df, metric).collect()
    assert len(rows) == 1600 and all((r.dist is None) == bool({r.qid, r.id} & {3, 17}) for r in rows)
    want = {(a, b) for a in {r.qid for r in rows} for _, b in sorted((r.dist, r.id) for r in rows if r.qid == a and r.dist is not None)[:4]}
    assert {(r.qid, r.id) for r in exact.blocked_knn(q, df, 4, metric, block=8).collect()} == want


def test_far_from_the_origin(spark):
    """Where products lose all digits of a distance, it's still the folded one that decides."""
    x = 1e6 + np.random.default_rng(2).integers(0, 4, (90, 3)) / 1024
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    df = table(spark, x)
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    got = {(r.qid, r.id) for r in exact.blocked_knn(q, df, 5, block=16).collect()}
    assert got == {(a, int(b)) for a in range(90) for b in np.lexsort((np.arange(90), d[a]))[:5]}
    inside = {(r.qid, r.id) for r in exact.blocked_within(q, df, 6 / 1024**2, block=16).collect()}
    assert inside == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 6 / 1024**2)), strict=True))


def test_numbers_without_end(spark):
    x = np.random.default_rng(3).normal(0, 1, (30, 3))
    x[4, 1], x[9, 0], x[11] = np.nan, np.inf, 1e200
    df = table(spark, x)
    q = df.where("id in (0, 9)").select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    with np.errstate(all="ignore"):
        d = np.cumsum((x[:, None] - x[None]) ** 2, axis=-1)[..., -1]
    for k in (5, 29):
        got = {(r.qid, r.id) for r in exact.blocked_knn(q, df, k, block=8).collect()}
        assert got == {(a, int(b)) for a in (0, 9) for b in np.lexsort((np.arange(30), d[a]))[:k]}


def test_rounding_is_that_of_sql():
    x = np.array([0.0000005, -0.0000005, 1.4999995, 2.5000005, -1e-9, 0.49999999999999994e-6, -123456.7890125, np.inf, np.nan, 1e305])
    want = duckdb.sql(f"select round(x, 6) from (select unnest({[str(v) for v in x]}::double[]) x)").fetchall()
    assert np.array_equal(exact._round(x, 6), [v for v, in want], equal_nan=True)


def test_tiles_stay_small():
    """What is computed at once doesn't grow with the tables."""
    x = np.random.default_rng(4).normal(0, 1, (3000, 4))
    assert exact.BLOCK * exact.STRIP * 8 <= 4 << 20
    near, _, sure = exact._near("l2sq", x[:256], x)
    hits = list(exact._hits("l2sq", x[:256], x, near, np.full(256, np.inf)))
    assert sure and max(len(i) for i, _, _ in hits) == exact.CHUNK and sum(len(i) for i, _, _ in hits) == near.size


def test_leaves_are_dealt_by_key(spark):
    rng = np.random.default_rng(5)
    x, leaf = rng.normal(0, 1, (200, 3)), rng.integers(0, 3, 200)
    df = table(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(leaf)], "id long, leaf int"), "id")
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qv"), "leaf")
    d = np.where(leaf[:, None] == leaf[None], ((x[:, None] - x[None]) ** 2).sum(-1), np.inf)
    got = {(r.qid, r.id) for r in exact.blocked_knn(q, df, 4, block=16, key="leaf").collect()}
    assert got == {(a, int(b)) for a in range(200) for b in np.argsort(d[a])[:4]}


def test_integer_pairs_are_generated_code(spark, sf):
    df = catalog.QUERIES["d2_d4_integer_pairs"](spark, sf)
    assert "aggregate(" not in plan(df) and "Repartition" in plan(df)


def test_truth_is_computed_once(spark):
    from skerry.operators import evaluate

    calls = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            calls.add(1)
            yield batch

    truth = spark.createDataFrame([(0, 1, 1, 0.5)], "qid long, rank int, id long, dist double").coalesce(1).mapInArrow(rows, "qid long, rank int, id long, dist double")
    assert evaluate.recall(truth, truth.sparkSession.createDataFrame([(0, 1)], "qid long, id long"), 1).first()["recall"] == 1 and calls.value == 1


def test_a_block_travels_as_one_row(spark, sf):
    """Of all k nearest of a block, not a row each, in the exchange; what singles out candidates is of single precision."""
    b = catalog.base(spark, sf)
    near = exact.blocked_knn(b.select(F.col("id").alias("qid"), F.col("vec").alias("qv")), b, 8, others=True)
    exchange = next(line for line in plan(near).splitlines() if "RepartitionByExpression" in line)
    assert "q0" in exchange
    x = np.array([r.vec for r in b.orderBy("id").collect()], np.float32)
    low = exact._Low("l2sq", x, x)
    d = np.cumsum((x[:, None].astype(float) - x[None]) ** 2, axis=-1)[..., -1]
    hits = list(low.hits(0, x[:256], x, np.full(256, 1.2), 9))
    assert low.fits and {(a, b) for i, j, _ in hits for a, b in zip(i.tolist(), j.tolist())} >= set(zip(*map(np.ndarray.tolist, np.nonzero(d[:256] <= 1.2)), strict=True))


def test_others_among_many_copies(spark):
    """More copies than neighbours, far from the origin and near it, in single precision; a query's own id is no answer."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(0, 1, (3, 6)), 14, axis=0), 1e4 + rng.integers(0, 3, (60, 6)) / 64, rng.normal(0, 1, (40, 6))]).astype(np.float32)
    df = table(spark, x, "float")
    d = np.cumsum((x[:, None].astype(float) - x[None]) ** 2, axis=-1)[..., -1]
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    near = exact.blocked_knn(df.select(F.col("id").alias("qid"), F.col("vec").alias("qv")), df, 8, block=16, others=True).collect()
    assert {(r.qid, r["rank"], r.id) for r in near} == {(a, n + 1, int(b)) for a in range(len(x)) for n, b in enumerate(np.lexsort((np.arange(len(x)), d[a]))[:8])}


def test_edges_are_made_distinct_once(spark):
    """And not again at each step of a flood or of the levels."""
    from skerry.operators import graph

    calls = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            calls.add(1)
            yield batch

    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long").coalesce(1).mapInArrow(rows, "src long, dst long")
    everything = spark.createDataFrame([(0, i) for i in range(4)], "qid long, id long")
    assert graph.flood(edges, everything, everything.where("id = 0")).count() == 4 and calls.value == 1
    assert graph.levels(edges, 0).count() == 4 and calls.value == 2
