"""Search over codes: recall against exact neighbours, and lists that aren't read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import codes as Q
from plinth.operators import retrieval as R


def vectors_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>").repartition(4)


def recall(spark, table, queries, index, limit=20, **more):
    want = {(r["qid"], r["id"]) for r in R.dense_leg(table, queries, limit).collect()}
    got = index.search(table, queries, limit, **more).collect()
    assert len(got) == len({(r["qid"], r["id"]) for r in got})
    return len({(r["qid"], r["id"]) for r in got} & want) / len(want)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 32)).repeat(100, axis=0) + 0.7 * rng.standard_normal((4000, 32))
    table = vectors_of(spark, x)
    return table, Q.build(table, f"file://{tmp_path_factory.mktemp('c')}/index"), table.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def test_recall_of_clustered_vectors(spark, made):
    table, index, queries = made
    assert index.lists().count() == 4000 and 1 <= index.probes < len(index.centres)
    assert recall(spark, table, queries, index) >= 0.95
    scores = {(r["qid"], r["id"]): r["score"] for r in R.dense_leg(table, queries, 20, 6).collect()}
    assert all(scores[r["qid"], r["id"]] == r["score"] for r in index.search(table, queries, 20, 6).collect() if (r["qid"], r["id"]) in scores)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_recall_of_the_tables(spark, tmp_path, scale):
    e = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = Q.build(e, f"file://{tmp_path}/i")
    assert recall(spark, e, e.select(F.col("id").alias("qid"), F.col("vector").alias("query")), index) >= 0.95


def test_other_lists_are_not_read(spark, made):
    table, index, queries = made
    one = queries.limit(1)
    lists = [r["list"] for r in index.asked(one, 2).select("list").distinct().collect()]
    assert len(lists) == 2
    rows = index.lists(lists)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("/list=")[1].split("/")[0] for f in rows.select("id", F.input_file_name().alias("f")).toPandas()["f"]}
    assert read == {str(n) for n in lists}
    assert index.search(table, one, 5, probes=2).count() == 5


def test_hot_lists_and_many_queries_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "PART_ROWS", 50)
    monkeypatch.setattr(Q, "QUERY_ROWS", 7)
    rng = np.random.default_rng(7)
    x = np.r_[np.ones((300, 16)) + 0.05 * rng.standard_normal((300, 16)), rng.standard_normal((300, 16))]
    table = vectors_of(spark, x)
    index = Q.build(table, f"file://{tmp_path}/h", limit=10)
    queries = table.filter("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    assert max(index.parts.values()) > 1 and recall(spark, table, queries, index, 10, probes=len(index.centres)) >= 0.95
    assert len(Q.load(spark, f"file://{tmp_path}/h").centres) == len(index.centres)


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.1]), (7, [-1.0, None])]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "qid long, query array<double>")
    index = Q.build(table, f"file://{tmp_path}/o")
    assert [(r["qid"], r["id"]) for r in index.search(table, queries, 5).orderBy("rank").collect()] == [(1, 1), (1, 6)]
    empty = table.limit(0)
    assert Q.build(empty, f"file://{tmp_path}/e").search(empty, queries, 5).collect() == []


def test_many_exact_queries_meet_parts(spark, made, monkeypatch):
    table, _, queries = made
    table = table.unionByName(spark.createDataFrame([(-1, [1.0]), (-2, None), (-3, [0.0] * 32)], "id long, vector array<double>"))
    queries = queries.unionByName(spark.createDataFrame([(-1, [2.0]), (-2, None)], "qid long, query array<double>"))
    want = sorted(map(tuple, R.dense_leg(table, queries, 7, 6).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 9)
    monkeypatch.setattr(R, "PART_ROWS", 700)
    assert sorted(map(tuple, R.dense_leg(table, queries, 7, 6).collect())) == want and any(r[0] == -1 for r in want)
