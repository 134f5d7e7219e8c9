import numpy as np
import pytest

from skerry.operators.index import BuildParams, Index
from skerry import sources


@pytest.mark.parametrize("kind", ["fbin", "u8bin", "i8bin", "fvecs", "bvecs", "ivecs"])
@pytest.mark.parametrize("n", [1, 1000])
def test_vectors_round_trip(spark, tmp_path, kind, n):
    rows = [(i, [float(i % 100), float(i * 7 % 120), 3.0]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    path = str(tmp_path / f"x.{kind}")
    assert sources.write_vectors(df, path, kind) == n
    sources.register(spark)
    back = spark.read.format("vectorfile").option("path", path).option("kind", kind).option("rows", 300).load().orderBy("id").collect()
    assert [(r.id, [float(x) for x in r.vec]) for r in back] == rows


def test_tables_round_trip(spark, tmp_path):
    sources.register(spark)
    read = lambda kind, path: spark.read.format("vectorfile").option("path", path).option("kind", kind).option("rows", 2).load()
    near = spark.createDataFrame([(q, r, q * 10 + r, r / 2) for q in range(5) for r in (1, 2, 3)], "qid long, rank int, id long, dist double")
    sources.write_neighbours(near, str(tmp_path / "g.ibin"), 3)
    assert sorted(map(tuple, read("ibin", str(tmp_path / "g.ibin")).collect())) == sorted(map(tuple, near.collect()))
    lists = [(0, [1, 2]), (1, []), (2, [5]), (3, [1, 2, 3])]
    sources.write_ranges(spark.createDataFrame(lists, "qid long, ids array<long>"), str(tmp_path / "r"))
    assert sorted((r.qid, r.ids) for r in read("range", str(tmp_path / "r")).collect()) == lists
    sources.write_graph(spark.createDataFrame(lists, "id long, nbrs array<long>"), str(tmp_path / "h"))
    assert sorted((r.id, r.nbrs) for r in read("graph", str(tmp_path / "h")).collect()) == lists
    assert sources.read_header(str(tmp_path / "h")) == (4, 3)


def test_index_saved_sharded_and_streamed(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    base = spark.createDataFrame(rows, "id long, vec array<double>")
    index = Index.build(base, BuildParams("descent", degree=12, shard=80))
    index.save(str(tmp_path / "index"))
    again = Index.load(spark, str(tmp_path / "index"))
    q = base.where("id < 5").selectExpr("id qid", "vec qv")
    found = again.search(q, 3, 32)
    assert {r.qid: r.id for r in found.where("rank = 1").collect()} == {i: i for i in range(5)}
    q.write.parquet(str(tmp_path / "in"))
    from skerry.streaming import search_stream

    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    search_stream(stream, again, 3, str(tmp_path / "out"), str(tmp_path / "ck"), 32).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
