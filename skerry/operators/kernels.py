"""Sequential kernels over numpy arrays, for one shard of vectors at a time.

All use the total order (distance, number), so that results don't depend on
how the data was partitioned. A graph is a list of integer arrays.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np

#: Up to so many rows beam_searches() may be used: a search compares most of them anyway.
FEW = 1024


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "mips":
        return -(x @ q)
    if metric == "hamming":  # of words
        return np.bitwise_count(x ^ q).sum(axis=1, dtype=np.int64).astype(float)
    if metric == "cosine":
        return 1 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def beam_search(graph: list[np.ndarray], x: np.ndarray, q: np.ndarray, starts: list[int], beam: int, metric: str = "l2sq", limit: int | None = None, degree: int | None = None, batch: float = 0.0, own: int = -1, stop: Callable[[list, list], bool] | None = None, coarse: Callable[[list[int]], np.ndarray] | None = None) -> tuple[list[tuple[float, int]], list[tuple[float, int]], int]:
    """(frontier, visited, distances computed). own: a row that is never returned; stop: an early-stopping test.

    coarse: distances of rows by cheaper codes. While the frontier is full, a neighbour is compared only if its coarse
    distance is below the mean, over the steps so far, of the frontier's mean coarse distance.
    """
    if not starts or len(starts) > beam:
        raise ValueError("between one and beam starts are needed")
    d = distances(metric, q, x[starts])
    front = sorted(set(zip(d.tolist(), starts, strict=True)))
    seen, visited, done, cost = set(starts), [], set(), len(starts)
    pending: list[tuple[float, int]] = []
    limit = len(x) if limit is None else limit
    at, last, mean, means = 0, -1, 0.0, []  # at: all before it in the frontier are done
    while len(visited) < limit:
        while at < len(front) and front[at][1] in done:
            at += 1
        if at == len(front) or (stop and stop(front, visited)):
            break
        best = front[at]
        visited.append(best)
        done.add(best[1])
        new = [i for i in graph[best[1]][:degree].tolist() if i not in seen and i != own]
        seen.update(new)
        if coarse and len(front) == beam:
            if front[-1][1] != last:
                last, mean = front[-1][1], float(coarse([i for _, i in front]).mean())
            means.append(mean)
            if new:
                new = [i for i, c in zip(new, coarse(new).tolist(), strict=True) if c < sum(means) / len(means)]
        if new:
            cut = front[-1][0] if len(front) == beam else np.inf
            d = distances(metric, q, x[new])
            cost += len(new)
            pending += [(a, i) for a, i in zip(d.tolist(), new, strict=True) if a < cut]
        if batch and limit >= 2 * beam and len(pending) < batch * beam and any(f[1] not in done for f in front[at + 1 :]):
            continue
        for f in pending:  # each into its place, as sorting anew would cost the beam's length a visit
            if len(front) < beam or f < front[-1]:
                place = bisect.bisect(front, f)
                if place and front[place - 1] == f:  # a repeated edge
                    continue
                front.insert(place, f)
                at = min(at, place)
                del front[beam:]
        pending = []
    return front, sorted(visited), cost


def beam_searches(graph: np.ndarray, d: np.ndarray, starts: np.ndarray, beam: int, limit: int | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """beam_search() of many queries in step, over few rows whose distances are all known. graph: a row's neighbours, filled
    up with -1; d: query by row; starts: a row for each query; own: rows that are never returned.

    For each query the rows in the order (distance, number), and what became of each: 2 visited, 1 compared, 0 not.
    The frontier is the first beam of those above 0. Equal distances go by number in all places.
    """
    m, n = d.shape
    order = np.argsort(d, axis=1, kind="stable")
    rank = np.empty((m, n), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[None, :], axis=1)
    state = np.zeros((m, n), np.uint8)
    state[np.arange(m), rank[np.arange(m), starts]] = 1
    hidden = None if own is None else rank[np.arange(m), own]
    live = np.arange(m)
    for step in range(n if limit is None else limit):
        part = state if len(live) == m else state[live]
        at = np.argmax(part == 1, axis=1)
        more = part[np.arange(len(live)), at] == 1
        if step >= beam:  # before that there aren't so many visited
            more &= ((part > 0) & (np.arange(n) < at[:, None])).sum(axis=1) < beam
        live, at = live[more], at[more]
        if not len(live):
            break
        state[live, at] = 2
        to = graph[order[live, at]]
        i, j = np.nonzero(to >= 0)
        i, j = live[i], rank[live[i], to[i, j]]
        new = state[i, j] == 0
        if hidden is not None:
            new &= j != hidden[i]
        state[i[new], j[new]] = 1
    return order, state


def padded(graph: list[np.ndarray], degree: int | None = None) -> np.ndarray:
    """The lists of a graph as rows of equal length, filled up with -1."""
    out = np.full((len(graph), max(1, max((len(g[:degree]) for g in graph), default=0))), -1, np.int64)
    for row, g in zip(out, graph):
        row[: len(g[:degree])] = g[:degree]
    return out


def robust_prune(p: int, candidates: list[tuple[float, int]], x: np.ndarray, alpha: float, most: int, metric: str = "l2sq") -> list[int]:
    """Keeps the nearest candidate and drops all that are alpha times nearer to it than to p; and so on."""
    c = sorted({i: d for d, i in candidates if i != p}.items(), key=lambda t: (t[1], t[0]))
    ids, dist = np.array([i for i, _ in c], int), np.array([d for _, d in c])
    alive, kept = np.ones(len(c), bool), []
    for k in range(len(c)):
        if len(kept) == most:
            break
        if alive[k]:
            kept.append(int(ids[k]))
            alive[k + 1 :] &= alpha * distances(metric, x[ids[k]], x[ids[k + 1 :]]) > dist[k + 1 :] if k + 1 < len(c) else True
    return kept


def select_diverse(candidates: list[tuple[float, int]], x: np.ndarray, alpha: float, most: int, metric: str = "l2sq") -> list[int]:
    """Scans candidates by distance and keeps one unless a kept one is nearer to it than alpha times its own distance."""
    kept: list[int] = []
    for d, i in sorted(set(candidates)):
        if len(kept) == most:
            break
        if not kept or not (distances(metric, x[i], x[kept]) < alpha * d).any():
            kept.append(i)
    return kept


def spanning_edges(x: np.ndarray, degree: int, near: int = 10, metric: str = "l2sq") -> list[tuple[int, int]]:
    """A degree-bounded minimum spanning forest of the ``near`` nearest later neighbours of each row."""
    n = len(x)
    edges = []
    for i in range(n - 1):
        d = distances(metric, x[i], x[i + 1 :])
        for j in np.lexsort((np.arange(len(d)), d))[:near].tolist():
            edges.append((float(d[j]), i, i + 1 + j))
    root, used, out = list(range(n)), [0] * n, []

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for _, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b and used[i] < degree and used[j] < degree:
            root[max(a, b)] = min(a, b)
            used[i] += 1
            used[j] += 1
            out += [(i, j), (j, i)]
    return out


def flood(graph: list[np.ndarray], x: np.ndarray, q: np.ndarray, inside: list[int], radius: float, metric: str = "l2sq") -> list[int]:
    """All vertices within the radius that edges reach from those inside through others within it."""
    seen, todo = set(inside), list(inside)
    while todo:
        new = [i for i in graph[todo.pop()].tolist() if i not in seen]
        if new:
            seen.update(new)
            d = distances(metric, q, x[new])
            hit = [i for i, a in zip(new, d.tolist(), strict=True) if a <= radius]
            todo += hit
            inside = inside + hit
    return sorted(inside)


def early_stop(radius: float, outer: float, beam: int) -> Callable[[list, list], bool]:
    """Gives a search up that has looked long enough and is far outside."""
    count = max(10, beam // 4)
    return lambda front, visited: len(visited) >= count and front[0][0] > radius and min((f for f in front if f not in visited), default=(np.inf,))[0] > outer


def range_search(graph: list[np.ndarray], x: np.ndarray, q: np.ndarray, radius: float, beam: int, mode: str = "beam", metric: str = "l2sq", outer: float | None = None) -> list[int]:
    """Vertices within the radius: beam (those the search ends with), greedy (flooded when all are inside), or
    doubling (a wider beam while all are inside)."""
    stop = early_stop(radius, outer, beam) if outer is not None else None
    starts = [0]
    while True:
        front, _, _ = beam_search(graph, x, q, starts, beam, metric, stop=stop)
        inside = [i for d, i in front if d <= radius]
        if mode == "beam" or len(inside) < beam:
            return sorted(inside)
        if mode == "greedy":
            return flood(graph, x, q, inside, radius, metric)
        starts, beam, stop = [i for _, i in front], 2 * beam, None


def cluster_leaves(x: np.ndarray, leaf: int, seed: int, metric: str = "l2sq") -> list[np.ndarray]:
    """Random two-pivot splits until leaves hold at most ``leaf`` rows; equal pivots or an empty side halve."""
    rng = np.random.default_rng(seed)
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        a, b = own[rng.choice(len(own), 2, replace=False)]
        left = distances(metric, x[a], x[own]) <= distances(metric, x[b], x[own])
        if (x[a] == x[b]).all() or left.all() or not left.any():
            left = np.arange(len(own)) < len(own) // 2
        todo += [own[left], own[~left]]
    return out
