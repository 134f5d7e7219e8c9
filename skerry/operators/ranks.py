"""Values of an exact rank, found by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a range is cut into; so many counts reach the driver in each pass.
CELLS = 4096


def at_rank(values: DataFrame, column: str | Column, rank: int) -> float:
    """The value (as double) that stands at a rank, from 0, among the sorted non-null values.

    Each pass counts the values of the present range in equal cells and goes on with the cell that holds the
    rank, until all values in it are equal. Cells are ordered like their values, so the result is exact.
    """
    x = values.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("x")).where("x is not null")
    n, lo, hi = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} of {n} values")
    while lo < hi:
        # halves keep the width of any range finite
        at = F.least(F.lit(CELLS - 1.0), F.floor((F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS))
        cells = x.where(F.col("x").between(lo, hi)).groupBy(at.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for c in sorted(cells.collect(), key=lambda c: c["lo"]):
            if rank < c["n"]:
                lo, hi = c["lo"], c["hi"]
                break
            rank -= c["n"]
    return lo
