"""Graphs as edge tables (src, dst, rank): statistics, traversal and neighbour-descent steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.metrics import l2sq
from skerry.operators.lineage import cut

#: When a kept neighbour at distance ``near`` from a candidate drops it, which is ``far`` from the vertex.
RULES = {
    "vamana": lambda near, far, alpha: near * alpha <= far,
    "hnsw": lambda near, far, alpha: near < far * alpha,
    "descent": lambda near, far, alpha: near * alpha < far,
}


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex, out_degree, in_degree; vertices: id."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return vertices.join(out, "id", "left").join(into, "id", "left").select(F.col("id").alias("vertex"), zero("out_degree"), zero("in_degree"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def levels(edges: DataFrame, start: int) -> DataFrame:
    """vertex, level: breadth-first levels from a vertex, one anti-join a level, until no vertex is new."""
    spark = edges.sparkSession
    seen = front = cut(spark.createDataFrame([(start, 0)], "vertex long, level int"))
    pairs = cut(edges.select("src", F.col("dst").alias("vertex")).distinct())  # read at each level
    for level in itertools.count(1):
        reached = front.select(F.col("vertex").alias("src")).join(pairs, "src").select("vertex").distinct()
        front = cut(reached.join(seen, "vertex", "left_anti").select("vertex", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def reverse_neighbours(edges: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """src, dst: up to ``most`` in-neighbours of each vertex, in the order of a hash."""
    order = Window.partitionBy("src").orderBy(arithmetic_hash(F.col("dst"), seed), "dst")
    return transpose(edges).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("src", "dst")


def arithmetic_hash(c, seed: int):
    """A hash that any SQL engine can compute."""
    return (c.cast("long") * 2654435761 + seed * 40503) % 2147483647


def edge_bytes(edges: DataFrame) -> DataFrame:
    """src, n_bytes: one byte for a gap below 128 between sorted neighbours, two below 16384, else three."""
    gap = F.col("dst") - F.lag("dst", 1, 0).over(Window.partitionBy("src").orderBy("dst"))
    return edges.select("src", "dst", F.when(gap < 128, 1).when(gap < 16384, 2).otherwise(3).alias("b")).groupBy("src").agg(F.sum("b").cast("long").alias("n_bytes"))


def offsets(edges: DataFrame) -> DataFrame:
    """src, n, first: degrees and their exclusive prefix sums: within ranges of vertices, plus the totals of the
    ranges before, of which there is one row a partition."""
    n = edges.groupBy("src").agg(F.count("*").alias("n"))
    ranged = cut(n.repartitionByRange("src").withColumn("part", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    within = ranged.select("src", "n", "part", before(Window.partitionBy("part").orderBy("src")).alias("own"))
    return within.join(F.broadcast(totals), "part").select("src", "n", (F.col("own") + F.col("base")).cast("long").alias("first"))


def descent_candidates(edges: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """a < b: vertices that share an in-neighbour list and aren't neighbours yet."""
    rev = cut(reverse_neighbours(edges, most, seed))
    pairs = rev.alias("x").join(rev.alias("y"), (F.col("x.src") == F.col("y.src")) & (F.col("x.dst") < F.col("y.dst")))
    pairs = pairs.select(F.col("x.dst").alias("a"), F.col("y.dst").alias("b")).distinct()
    known = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def union_bounded(lists: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """src, id, dist, rank: the k nearest of two lists (src, id, dist) without repeats."""
    order = Window.partitionBy("src").orderBy("dist", "id")
    both = lists.select("src", "id", "dist").union(more.select("src", "id", "dist")).dropDuplicates(["src", "id", "dist"])
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def prune(candidates: DataFrame, vectors: DataFrame, alpha: float, most: int, rule: str = "vamana", metric=l2sq) -> DataFrame:
    """src, dst, rank: the diverse neighbours of each vertex, by the rule of a builder.

    candidates: src, dst, dist; repeats count once. Nearest first, a candidate is kept unless one kept before is too
    near to it, up to ``most``. A fold over a vertex's sorted candidates within codegen; a vertex's candidates with
    their vectors stand in one row, as a search of a bounded beam or k lists give them.
    """
    told = candidates.where("src != dst").groupBy("src", "dst").agg(F.min("dist").alias("dist")).join(vectors.select(F.col("id").alias("dst"), "vec"), "dst")
    lists = told.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "vec"))).alias("c"))
    drops = RULES[rule]

    def step(kept, c):
        fits = (F.size(kept) < most) & ~F.exists(kept, lambda k: drops(metric(k["vec"], c["vec"]), c["dist"], F.lit(float(alpha))))
        return F.when(fits, F.concat(kept, F.array(c))).otherwise(kept)

    kept = F.aggregate(F.col("c"), F.slice(F.col("c"), 1, 0), step)
    return lists.select("src", F.posexplode(F.transform(kept, lambda k: k["dst"])).alias("p", "dst")).select("src", "dst", (F.col("p") + 1).alias("rank"))


def flood(edges: DataFrame, allowed: DataFrame, starts: DataFrame) -> DataFrame:
    """qid, id: vertices that a query reaches from its starts through allowed ones. allowed, starts: qid, id.

    One join a step, of the frontier only, until it's empty.
    """
    inside = cut(allowed.select("qid", "id").distinct())
    pairs = cut(edges.select("src", "dst").distinct())  # read at each step
    seen = front = cut(starts.select("qid", "id").distinct().join(inside, ["qid", "id"], "left_semi"))
    while not front.isEmpty():
        reached = front.select("qid", F.col("id").alias("src")).join(pairs, "src").select("qid", F.col("dst").alias("id")).distinct()
        front = cut(reached.join(inside, ["qid", "id"], "left_semi").join(seen, ["qid", "id"], "left_anti"))
        seen = cut(seen.union(front))
    return seen


def reach(edges: DataFrame, vertices: DataFrame, start: int) -> DataFrame:
    """One row: vertices, unreachable (from the start), radius (breadth-first levels, the start's included) and the
    largest level. vertices: id."""
    sizes = levels(edges, start).groupBy("level").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("n").alias("reached"), F.count("*").alias("radius"), F.max("n").alias("largest_level"))
    return vertices.agg(F.count("*").alias("vertices")).crossJoin(totals).select("vertices", (F.col("vertices") - F.col("reached")).alias("unreachable"), "radius", "largest_level")


def cluster_levels(vectors: DataFrame, depth: int, seed: int = 7) -> DataFrame:
    """id, node: leaves of a two-pivot tree, all nodes of a level split at once. vectors: id, vec.

    The pivots of a node are its rows of the smallest and largest hash; a row goes left (2 * node) unless it's nearer
    to the second (2 * node + 1). A node of one row, or of equal pivots, stays as 2 * node.
    """
    h = arithmetic_hash(F.col("id"), seed)
    rows = vectors.select("id", "vec", F.lit(1).cast("long").alias("node"))
    for _ in range(depth):
        pivots = rows.groupBy("node").agg(F.min_by("vec", F.struct(h, "id")).alias("x"), F.max_by("vec", F.struct(h, "id")).alias("y"))
        left = l2sq(F.col("vec"), F.col("x")) <= l2sq(F.col("vec"), F.col("y"))
        rows = cut(rows.join(pivots, "node").select("id", "vec", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node")))
    return rows.select("id", "node")
