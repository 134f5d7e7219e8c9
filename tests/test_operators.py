"""Ranks, offsets, sweeps and what indexes keep."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import builders, evaluate, exact, graph, index, kernels, ranks


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 300), np.full(50, 0.25), [1e300, -1e300, 5e-324, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").coalesce(2)
    for r in (0, 1, 120, 200, 352, 353):
        assert ranks.at_rank(df, "x", r) == np.sort(x)[r]
    with pytest.raises(ValueError):
        ranks.at_rank(df, "x", 354)
    assert evaluate.tail(df.limit(0), "x").first()["tail_value"] is None


def test_offsets_over_several_partitions(spark):
    rows = [(i, j) for i in range(0, 400, 3) for j in range(i % 7 + 1)]
    got = sorted(graph.offsets(spark.createDataFrame(rows, "src long, dst long").repartition(5)).collect())
    first, want = 0, []
    for i in range(0, 400, 3):
        want.append((i, i % 7 + 1, first))
        first += i % 7 + 1
    assert [tuple(r) for r in got] == want


def test_blocked_within(spark):
    x = np.random.default_rng(2).normal(0, 1, (70, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = df.select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    got = {(r.qid, r.id) for r in exact.blocked_within(q, df, 4.0, block=16).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 4.0)), strict=True))


def test_sweep_has_every_run(spark):
    rows = evaluate.sweep(spark, 10, 32).collect()
    assert len(rows) == 43 + 20 + 1 and (rows[-1].k, rows[-1].beam) == (100, 1000)
    assert {r.degree_limit for r in rows} == {32} and {r.visit_limit for r in rows if r.visit_limit} == {*range(10, 27), 28, 30, 35}


def test_graphs_as_plain_arrays():
    x = np.random.default_rng(3).normal(0, 1, (90, 6))
    flat = builders.vamana(x, 8, 16, 1.2, 1, "l2sq", 0)
    assert all((a == b).all() for a, b in zip(index.unpacked(index.packed(flat), x, "l2sq"), flat, strict=True))
    h = builders.Hnsw(x, 6, 20)
    again = index.unpacked(index.packed(h), x, "l2sq")
    assert again.layers == h.layers and again.entry == h.entry
    assert again.search(x[5], 4, 20) == h.search(x[5], 4, 20) and h.visits >= 1 and h.costs >= h.visits
    with pytest.raises(ValueError):
        index.unpacked(pickle.dumps([1]), x, "l2sq")


def test_index_is_built_once(spark):
    x = np.random.default_rng(4).normal(0, 1, (60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    built = index.Index.build(df, index.BuildParams(kind="hnsw", degree=8, beam=16, shard=30))
    assert "FlatMapGroups" not in built.shards._jdf.queryExecution().toString()
    q = df.where("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    rows = built.search(q, 3, 16).collect()
    assert {r.id for r in rows if r["rank"] == 1} == set(range(5)) and min(r.n_visited for r in rows) > 0 and min(r.n_cmps for r in rows) > 0


def test_searches_of_a_fixed_graph():
    """What is found, visited and compared, counted by hand on a path of six points."""
    x = np.arange(6, dtype=float)[:, None]
    path = [np.array([j for j in (i - 1, i + 1) if 0 <= j < 6]) for i in range(6)]
    front, visited, cost = kernels.beam_search(path, x, np.array([4.2]), [0], 2)
    assert [i for _, i in front] == [4, 5] and {i for _, i in visited} == set(range(6)) and cost == 6
    front, visited, cost = kernels.beam_search(path, x, np.array([4.2]), [0], 2, limit=2)
    assert [i for _, i in front] == [2, 1] and [i for _, i in visited] == [1, 0] and cost == 3
    for mode, found in (("beam", [4, 5]), ("greedy", [3, 4, 5]), ("doubling", [3, 4, 5])):  # a beam of two holds no more
        assert sorted(kernels.range_search(path, x, np.array([4.2]), 1.5, 2, mode, "l2sq", None)) == found


def test_small_shards_are_built_apart(spark):
    """Few bytes aren't few minutes: shards aren't put together by their size."""
    x = np.random.default_rng(7).normal(0, 1, (400, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    built = index.Index.build(df, index.BuildParams(degree=4, beam=8, shard=20))
    assert built.shards.rdd.getNumPartitions() == 32 and built.shards.count() == 20
    assert sum(r.n > 0 for r in built.shards.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) >= 10
