import time

import numpy as np
import pytest

from skerry.operators import builders, kernels

LINE = np.array([[0.0], [1.0], [2.0], [3.0], [4.0]])


def test_prune_on_a_line_keeps_the_nearest_on_each_side():
    c = [(float((LINE[i, 0] - 2) ** 2), i) for i in (0, 1, 3, 4)]
    assert kernels.robust_prune(2, c, LINE, 1.0, 4) == [1, 3]
    assert kernels.robust_prune(2, c, LINE, 1.0, 1) == [1]
    assert kernels.select_diverse(c, LINE, 1.0, 4) == [1, 3]


def test_wide_beam_on_a_connected_graph_is_exact():
    x = np.random.default_rng(0).normal(size=(60, 5))
    graph = [np.array([(i - 1) % 60, (i + 1) % 60]) for i in range(60)]
    q = np.zeros(5)
    front, visited, cost = kernels.beam_search(graph, x, q, [0], 60)
    d = kernels.distances("l2sq", q, x)
    assert [i for _, i in front] == np.lexsort((np.arange(60), d)).tolist()
    assert len(visited) == cost == 60


def test_starts_must_fit_the_beam():
    with pytest.raises(ValueError):
        kernels.beam_search([np.zeros(0, int)] * 5, LINE, LINE[0], [0, 1, 2], 2)


@pytest.mark.parametrize("n", [0, 1, 2, 49, 50])
def test_builders_on_few_rows(n):
    x = np.random.default_rng(1).normal(size=(n, 3))
    for graph in (builders.vamana(x, 4, 8), builders.hcnng(x, 2, 10), builders.descent(x, 4, 2, 10)):
        assert len(graph) == n
        for i, g in enumerate(graph):
            assert i not in g and len(set(g.tolist())) == len(g)
            d = kernels.distances("l2sq", x[i], x[g]) if len(g) else np.zeros(0)
            assert (np.diff(d) >= 0).all()
    assert len(builders.Hnsw(x, 4, 8).search(np.zeros(3), 3, 8)) == min(n, 3)


def test_equal_rows_are_split_and_linked():
    x = np.zeros((30, 2))
    leaves = kernels.cluster_leaves(x, 4, 0)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(30)) and max(map(len, leaves)) <= 4
    edges = kernels.spanning_edges(x, 3)
    assert len(edges) == 58


def test_flood_stays_within_the_radius():
    graph = [np.array([1]), np.array([0, 2]), np.array([1, 3]), np.array([2, 4]), np.array([3])]
    assert kernels.flood(graph, LINE, np.array([0.0]), [0], 4.0) == [0, 1, 2]
    assert kernels.range_search(graph, LINE, np.array([0.0]), 4.0, 2, "doubling") == [0, 1, 2]


def test_beams_are_not_sorted_at_each_visit():
    """A visit costs its neighbours, not the beam: the same results as by sorting anew, with a wide beam in little time."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (6000, 8))
    graph = [rng.integers(0, 6000, 12) for _ in range(6000)]
    began = time.process_time()
    front, visited, _ = kernels.beam_search(graph, x, x[0], [0], 5000)
    assert time.process_time() - began < 1.5
    assert len(front) == 5000 and len(visited) >= 5000
    for beam in (7, 40):
        d = ((x - x[0]) ** 2).sum(1)
        known, seen, done = [(d[0], 0)], {0}, set()
        while todo := [f for f in known if f[1] not in done]:
            done.add(todo[0][1])
            new = [i for i in dict.fromkeys(graph[todo[0][1]].tolist()) if i not in seen]
            seen.update(new)
            cut = known[-1][0] if len(known) == beam else np.inf
            known = sorted({*known, *((d[i], i) for i in new if d[i] < cut)})[:beam]
        front, visited, _ = kernels.beam_search(graph, x, x[0], [0], beam)
        assert [i for _, i in front] == [i for _, i in known] and {i for _, i in visited} == done
    assert len(front) == 40


def test_descent_holds_few_neighbours_a_row():
    """Not those of all trees' leaves at once."""
    import tracemalloc

    x = np.random.default_rng(7).normal(size=(400, 4))
    peaks = []
    for trees in (1, 12):
        tracemalloc.start()
        builders.descent(x, 4, trees, 100, delta=1.0)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_searches_in_step_are_those_one_by_one():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 6))
    graph = [np.unique(rng.integers(0, 300, rng.integers(1, 9))) for _ in range(300)]
    q, starts = rng.normal(0, 1, (40, 6)), rng.integers(0, 300, 40)
    d = np.stack([kernels.distances("l2sq", v, x) for v in q])
    for beam, limit, degree, own in ((1, None, None, None), (12, None, None, None), (12, 5, 3, None), (400, None, None, None), (30, None, None, starts)):
        order, state = kernels.beam_searches(kernels.padded(graph, degree), d, starts, beam, limit, own)
        for n in range(40):
            front, visited, cost = kernels.beam_search(graph, x, q[n], [int(starts[n])], beam, limit=limit, degree=degree, own=-1 if own is None else int(own[n]))
            assert order[n][state[n] > 0][:beam].tolist() == [i for _, i in front]
            assert order[n][state[n] == 2].tolist() == [i for _, i in visited] and (state[n] > 0).sum() == cost


def test_many_queries_are_searched_in_step(spark, sf):
    """A query of a shard of 500 rows costs a fraction of a walk of its own."""
    from skerry import catalog
    from skerry.operators import index

    graph = builders.vamana(x := np.random.default_rng(1).normal(size=(500, 64)), 24, 48, single=8)
    q = np.random.default_rng(2).normal(size=(512, 64))
    began = time.process_time()
    kernels.beam_searches(kernels.padded(graph), np.stack([kernels.distances("l2sq", v, x) for v in q]), np.zeros(512, int), 64)
    in_step, began = time.process_time() - began, time.process_time()
    for v in q:
        kernels.beam_search(graph, x, v, [0], 64)
    assert 2 * in_step < time.process_time() - began
    built = index.Index.build(catalog.base(spark, sf), index.BuildParams(degree=8, beam=16, shard=200))
    found = {tuple(r) for r in built.search(catalog.asked(spark, sf), 5, 20).select("qid", "id", "n_visited", "n_cmps").collect()}
    x, want = {r.id: np.array(r.vec, float) for r in catalog.base(spark, sf).collect()}, set()
    for row in built.shards.collect():
        ids, vecs = np.frombuffer(row.ids, np.int64), np.frombuffer(row.vecs).reshape(-1, 64)
        for qid in (i for i in x if i % 20 == 0):
            front, visited, cost = kernels.beam_search(index.unpacked(row.graph, vecs, "l2sq"), vecs, x[qid], [0], 20)
            want |= {(qid, int(ids[i]), len(visited), cost) for _, i in front[:5]}
    assert len(found) == 5 * len({f[0] for f in found}) and found <= want
