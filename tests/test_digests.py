"""Audits by digest trees against the join of all rows, and how much they read."""

from pathlib import Path

from pyspark.sql import functions as F

from plinth.operators import catalog as C
from plinth.operators import digests as D


def rows(spark, n=20_000):
    return spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))


def files_read(side, leaves):
    return {r[0] for r in side.rows(leaves).select(F.input_file_name()).distinct().collect()}


def test_one_changed_key_reads_under_a_tenth(spark, tmp_path):
    a = D.write(rows(spark), f"file://{tmp_path}/a", 128, 16)
    b = D.write(rows(spark).withColumn("digest", F.when(F.col("id") == 777, "other").otherwise(F.col("digest"))), f"file://{tmp_path}/b", 128, 16)
    leaves = D.differing(a, b)
    assert len(leaves) == 1
    every = sum(p.stat().st_size for p in Path(tmp_path, "a", "rows").rglob("*.parquet"))
    read = sum(Path(f.removeprefix("file://")).stat().st_size for f in files_read(a, leaves))
    assert 0 < read < every / 10
    assert [tuple(r) for r in D.unmatched(a, b).collect()] == [(777, "incompatible")]
    assert tuple(D.result(a, b).first()) == (19_999, 0, 0, 1, 0, "drift")


def test_against_the_whole_join(spark, tmp_path):
    stored = rows(spark, 3000).withColumn("owner", F.when(F.col("id") % 97 == 0, False).when(F.col("id") % 101 != 0, True)).filter("id % 50 <> 7")
    proof = rows(spark, 3100).filter("id % 60 <> 9").withColumn("digest", F.when(F.col("id") % 333 == 0, "x").otherwise(F.col("digest")))
    a, b = D.write(stored, f"file://{tmp_path}/a", 64, 8), D.write(proof, f"file://{tmp_path}/b", 64, 8)
    verdicts = C.audit(stored, proof)
    assert sorted(map(tuple, D.unmatched(a, b).collect())) == sorted(map(tuple, verdicts.filter("verdict <> 'matched'").collect()))
    assert D.result(a, b).first() == C.audit_result(verdicts).first()


def test_equal_and_empty_sides(spark, tmp_path):
    a, b, none = (D.write(rows(spark, n), f"file://{tmp_path}/{k}", 16, 4) for k, n in (("a", 100), ("b", 100), ("none", 0)))
    assert D.differing(a, b) == [] and D.unmatched(a, b).collect() == []
    assert tuple(D.result(a, b).first()) == (100, 0, 0, 0, 0, "consistent")
    assert tuple(D.result(none, b).first()) == (0, 0, 0, 0, 100, "drift") and tuple(D.result(none, none).first())[:1] == (0,)
