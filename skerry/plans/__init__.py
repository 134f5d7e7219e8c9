"""Choosing a plan from sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skerry.operators import exact
from skerry.operators.index import Index


def search(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2sq", index: Index | None = None, beam: int = 64) -> DataFrame:
    """The index, if there is one; else exact search: natively for a broadcast query set of up to 100 rows,
    by blocks for more."""
    if index is not None:
        return index.search(queries, k, max(beam, k))
    if exact._size(queries) <= exact.MOST_BROADCAST and queries.limit(101).count() <= 100:
        return exact.knn(queries, base, k, metric)
    return exact.blocked_knn(queries, base, k, metric)


def coding(metric: str, dim: int, quantised: bool = True) -> dict:
    """The parameters of an index's codes by metric and dimension: bytes, beyond 800 dimensions (200 for inner products,
    which are normalised) filtered by a coarser level."""
    if not quantised or metric == "cosine":
        return {}
    if metric == "mips":
        return {"codes": "8", "normalise": True} | ({"coarse": "ternary"} if dim > 200 else {})
    return {"codes": "8"} | ({"coarse": "sketch"} if dim > 800 else {})
