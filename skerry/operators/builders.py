"""Builders of proximity graphs within a shard: Vamana, HNSW, HCNNG and nearest-neighbour descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from skerry.operators.kernels import FEW, beam_search, beam_searches, cluster_leaves, distances, padded, robust_prune, select_diverse, spanning_edges


def _batches(n: int) -> list[tuple[int, int]]:
    """Prefix doubling up to two per cent of the rows, then batches of that size."""
    most = max(1, min(int(0.02 * n), 1_000_000)) if n >= 50 else max(1, n)
    out, at, size = [], 0, 1
    while at < n:
        out.append((at, min(n, at + min(size, most))))
        at, size = out[-1][1], size * 2
    return out


def _sorted_by_distance(graph: list[np.ndarray], x: np.ndarray, metric: str) -> list[np.ndarray]:
    return [g[np.lexsort((g, distances(metric, x[i], x[g])))] if len(g) else g for i, g in enumerate(graph)]


def vamana(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, passes: int = 1, metric: str = "l2sq", seed: int = 0, single: int = 0) -> list[np.ndarray]:
    """Inserts batches: search, prune what was visited, add reverse edges and prune overfull vertices. Start: row 0.

    single: each row gets so many random edges first; then each pass is one batch, in which a row's search starts at itself.
    """
    n = len(x)
    graph = [np.zeros(0, int) for _ in range(n)]
    if single and n > 1:
        drawn = np.random.default_rng(seed + 1).integers(0, n - 1, (n, single))
        graph = [np.unique(g + (g >= i)) for i, g in enumerate(drawn)]
    order = np.concatenate(([0], 1 + np.random.default_rng(seed).permutation(n - 1))) if n else np.zeros(0, int)
    for k in range(passes):
        a = alpha if k == passes - 1 else 1.0
        for lo, hi in [(0, n)] if single else _batches(n):
            back: dict[int, list[int]] = {}
            new = {}
            each = _own_searches(graph, x, order, beam, metric) if single and n <= FEW else None
            for p in order[lo:hi].tolist():
                visited = next(each) if each else beam_search(graph, x, x[p], [p if single else 0], beam, metric, own=p)[1]
                old = graph[p]
                new[p] = robust_prune(p, visited + list(zip(distances(metric, x[p], x[old]).tolist(), old.tolist(), strict=True)), x, a, degree, metric)
            for p, out in new.items():
                graph[p] = np.array(out, int)
                for i in out:
                    back.setdefault(i, []).append(p)
            for i, sources in back.items():
                both = list(dict.fromkeys(sources + graph[i].tolist()))
                if len(both) > degree:
                    both = robust_prune(i, list(zip(distances(metric, x[i], x[both]).tolist(), both, strict=True)), x, a, degree, metric)
                graph[i] = np.array(both, int)
    return _sorted_by_distance(graph, x, metric)


def _own_searches(graph: list[np.ndarray], x: np.ndarray, rows: np.ndarray, beam: int, metric: str) -> Iterator[list[tuple[float, int]]]:
    """What the searches for the rows visit that start at themselves, in a graph that stays as it is meanwhile."""
    lists = padded(graph)
    for lo in range(0, len(rows), 512):
        own = rows[lo : lo + 512]
        d = np.stack([distances(metric, x[p], x) for p in own])
        if not np.isfinite(d).all():
            yield from (beam_search(graph, x, x[p], [p], beam, metric, own=p)[1] for p in own.tolist())
            continue
        for a, o, s in zip(d, *beam_searches(lists, d, own, beam, own=own)):
            at = o[s == 2]
            yield list(zip(a[at].tolist(), at.tolist()))


def hcnng(x: np.ndarray, trees: int = 10, leaf: int = 100, mst_degree: int = 3, metric: str = "l2sq", seed: int = 0) -> list[np.ndarray]:
    """The union over random cluster trees of spanning forests of the leaves."""
    out: list[set] = [set() for _ in range(len(x))]
    for t in range(trees):
        for own in cluster_leaves(x, leaf, seed * 1000 + t, metric):
            for i, j in spanning_edges(x[own], mst_degree, metric=metric):
                out[own[i]].add(int(own[j]))
    return _sorted_by_distance([np.array(sorted(s), int) for s in out], x, metric)


def descent(x: np.ndarray, k: int = 32, trees: int = 4, leaf: int = 100, alpha: float = 1.2, delta: float = 0.05, metric: str = "l2sq", seed: int = 0) -> list[np.ndarray]:
    """Nearest-neighbour descent from tree leaves, then reverse edges and pruning."""
    n = len(x)
    best: list[dict[int, float]] = [{} for _ in range(n)]
    trim = lambda b: dict(sorted(b.items(), key=lambda t: (t[1], t[0]))[:k])
    for t in range(trees):  # a row holds its k nearest so far and one leaf
        for own in cluster_leaves(x, leaf, seed * 1000 + t, metric):
            for i in own.tolist():
                d = distances(metric, x[i], x[own])
                few = np.lexsort((own, d))[: k + 1]
                best[i] = trim(best[i] | dict((j, a) for j, a in zip(own[few].tolist(), d[few].tolist(), strict=True) if j != i))
    fresh = [True] * n
    for _ in range(max(10, int(np.log2(max(x.shape[1], 2))))):
        near: list[set] = [set(b) for b in best]
        for i, b in enumerate(best):
            for j in b:
                if len(near[j]) < 2 * k:
                    near[j].add(i)
        changed = [False] * n
        for i in range(n):
            wider = {m for j in near[i] if fresh[i] or fresh[j] for m in near[j]} - near[i] - {i}
            if wider:
                more = sorted(wider)
                found = trim(best[i] | dict(zip(more, distances(metric, x[i], x[more]).tolist(), strict=True)))
                if found.keys() != best[i].keys():
                    best[i], changed[i] = found, True
        fresh = changed
        if sum(changed) <= delta * n:
            break
    both: list[dict[int, float]] = [dict(b) for b in best]
    for i, b in enumerate(best):
        for j, d in b.items():
            both[j][i] = d
    return [np.array(robust_prune(i, [(d, j) for j, d in b.items()], x, alpha, k, metric), int) for i, b in enumerate(both)]


class Hnsw:
    """Layers of graphs; a row's level is floor(-ln U * m_l)."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 64, alpha: float = 0.9, m_l: float | None = None, metric: str = "l2sq", seed: int = 0):
        self.x, self.metric = x, metric
        n = len(x)
        u = 1 - np.random.default_rng(seed).random(n)
        self.level = np.floor(-np.log(u) * (m_l or 1 / np.log(m))).astype(int) if n else np.zeros(0, int)
        self.layers: list[dict[int, list[int]]] = []
        self.visits = self.costs = 0  # of all searches so far
        self.entry = -1
        for p in range(n):
            self._insert(p, m, ef, alpha)

    def _search(self, layer: int, q: np.ndarray, starts: list[int], ef: int, own: int = -1) -> list[tuple[float, int]]:
        graph = _Layer(self.layers[layer])
        near = sorted(zip(distances(self.metric, q, self.x[starts]).tolist(), starts, strict=True))[:ef]
        front, visited, cost = beam_search(graph, self.x, q, [i for _, i in near], ef, self.metric, own=own)
        self.visits += len(visited)
        self.costs += cost + len(starts) - len(near)
        return front

    def _insert(self, p: int, m: int, ef: int, alpha: float) -> None:
        top = len(self.layers) - 1
        level = int(self.level[p])
        starts = [self.entry] if self.entry >= 0 else []
        for layer in range(top, level, -1):
            starts = [self._search(layer, self.x[p], starts, 1)[0][1]]
        for layer in range(min(top, level), -1, -1):
            most = 2 * m if layer == 0 else m
            found = self._search(layer, self.x[p], starts, ef, own=p)
            own = select_diverse([f for f in found if f[1] != p], self.x, alpha, most, self.metric)
            self.layers[layer][p] = own
            for i in own:
                out = self.layers[layer][i] + [p]
                if len(out) > most:  # the nearest stay
                    d = distances(self.metric, self.x[i], self.x[out])
                    out = [out[j] for j in np.lexsort((out, d))[:most].tolist()]
                self.layers[layer][i] = out
            starts = [i for _, i in found]
        while len(self.layers) <= level:
            self.layers.append({p: []})
            self.entry = p

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """The k nearest found, and all that equal the k-th distance. visits and costs then count this search."""
        self.visits = self.costs = 0
        if self.entry < 0:
            return []
        starts = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            starts = [self._search(layer, q, starts, 1)[0][1]]
        found = self._search(0, q, starts, max(ef, k))
        return [f for f in found if f[0] <= found[min(k, len(found)) - 1][0]]

    def statistics(self) -> list[tuple[int, int, int, int]]:
        """(layer, vertices, edges, largest out-degree)."""
        return [(i, len(g), sum(map(len, g.values())), max(map(len, g.values()), default=0)) for i, g in enumerate(self.layers)]


class _Layer:
    def __init__(self, edges: dict[int, list[int]]):
        self.edges = edges

    def __getitem__(self, i: int) -> np.ndarray:
        return np.array(self.edges[i], int)
