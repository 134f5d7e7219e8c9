"""Headline queries at BENCH_SF_DIR; prints one JSON line.

Beside the times, ``search`` holds recall, queries a second, comparisons and visits of a Vamana index when every
vector is a query, at three beams, and ``build_seconds`` the time to build it.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from skerry import catalog
from skerry.operators import evaluate, exact
from skerry.operators.index import BuildParams, Index

NAMES = ("ex1_knn_l2", "d15_knn_blocked", "ex2_range", "as6_rerank", "ev11_degree", "nn2_candidates", "qz1_codes", "ib2_vamana", "as8_hnsw", "hc3_hcnng", "nn5_nndescent", "as7_bytes", "ib1_prune", "d10_sketch_hamming")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["d1_l2sq_pairs"](spark, sf_dir).count()  # warm-up
    took = {}
    for name in NAMES:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    base = catalog.base(spark, sf_dir).repartition(int(cpus)).cache()
    queries = base.selectExpr("id qid", "vec qv")
    began = time.time()
    index = Index.build(base, BuildParams(degree=32, beam=64, shard=500))
    built = round(time.time() - began, 3)
    truth = exact.blocked_knn(queries, base, 100).cache()
    grid = evaluate.sweep(spark, 10, 32).where("k = 10 and visit_limit is null and beam in (10, 20, 50)")
    search = [r.asDict() for r in evaluate.measure(index, queries, truth, grid).collect()]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "build_seconds": built, "search": search, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
