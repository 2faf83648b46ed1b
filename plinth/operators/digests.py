"""Audits by digest trees: rows lie by ranges of their key's hash, and ranges with equal digests aren't read.

A side is (id, digest) rows in LEAVES ranges, each a folder, with the sum and number of its rows' hashes; FANOUT ranges
have a node of their own, and all nodes a top. Two sides are compared from the top down; only ranges that differ are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plinth.operators.catalog import audit, audit_result

LEAVES, FANOUT = 1024, 32
#: Ranges named in a filter, at most; more are joined.
MOST_NAMED = 2000


@dataclass
class Side:
    """Stored by write(): rows/leaf=n/ and level=0..2/ of (node, n, total)."""

    spark: SparkSession
    path: str
    fanout: int
    schema: StructType

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={k}")

    def rows(self, leaves: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return rows if leaves is None else rows.filter(F.col("leaf").isin(leaves))


def write(rows: DataFrame, path: str, leaves: int = LEAVES, fanout: int = FANOUT) -> Side:
    """rows (id, digest, and for a stored side owner: whether the row is ours) as a side at path. Foreign rows make their range differ."""
    spark = rows.sparkSession
    placed = rows.withColumn("leaf", F.pmod(F.xxhash64("id"), F.lit(leaves)).cast("int"))
    placed.repartition("leaf").sortWithinPartitions("leaf", "id").write.partitionBy("leaf").option("compression", "zstd").parquet(f"{path}/rows")
    own = F.xxhash64("id", "digest")
    own = own if "owner" not in rows.columns else F.when(F.coalesce("owner", F.lit(False)), own).otherwise(F.xxhash64("id", F.lit("foreign")))
    side = Side(spark, path, fanout, placed.schema)
    below = side.rows().groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), F.sum(own.cast("decimal(38,0)")).alias("total"))
    for k in range(3):
        below.repartitionByRange(1 if k else max(1, leaves // 4096), "node").sortWithinPartitions("node").write.parquet(f"{path}/level={k}")
        below = spark.read.parquet(f"{path}/level={k}")
        node = F.floor(F.col("node") / fanout).cast("int") if k == 0 else F.lit(0)
        below = below.groupBy(node.alias("up")).agg(F.sum("n").alias("n"), F.sum(F.xxhash64("node", "n", "total").cast("decimal(38,0)")).alias("total")).withColumnRenamed("up", "node")
    return side


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of which the two sides' sums or numbers differ, or that one lacks."""
    theirs = b.select("node", F.col("n").alias("_n"), F.col("total").alias("_t"))
    return a.join(theirs, "node", "full_outer").filter(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("total").eqNullSafe(F.col("_t")))).select("node")


def differing(a: Side, b: Side) -> list[int]:
    """The ranges in which the sides differ, from the top down. They are as many as there are ranges at most."""
    if _unlike(a.level(2), b.level(2)).isEmpty():
        return []
    nodes = [r["node"] for r in _unlike(a.level(1), b.level(1)).collect()]
    up = F.floor(F.col("node") / a.fanout).cast("int")
    return sorted(r["node"] for r in _unlike(*(s.level(0).filter(up.isin(nodes)) for s in (a, b))).collect())


def _verdicts(stored: Side, evidence: Side, leaves: list[int]) -> DataFrame:
    every = stored.rows(), evidence.rows()
    if len(leaves) <= MOST_NAMED:
        a, b = (rows.filter(F.col("leaf").isin(leaves)) for rows in every)
    else:
        wanted = stored.spark.createDataFrame([(x,) for x in leaves], "leaf int")
        a, b = (rows.join(wanted, "leaf", "left_semi") for rows in every)
    a = a if "owner" in a.columns else a.withColumn("owner", F.lit(True))
    return audit(a.drop("leaf"), b.select("id", "digest"))


def unmatched(stored: Side, evidence: Side) -> DataFrame:
    """(id, verdict) of audit() for all rows that don't match. Ranges without such rows aren't read."""
    return _verdicts(stored, evidence, differing(stored, evidence)).filter("verdict <> 'matched'")


def result(stored: Side, evidence: Side) -> DataFrame:
    """catalog.audit_result() of the sides: counts by verdict, and whether all match. Rows of equal ranges are counted from the digests alone."""
    leaves = differing(stored, evidence)
    counts = audit_result(_verdicts(stored, evidence, leaves))
    alike = stored.level(0).filter(~F.col("node").isin(leaves)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    return counts.join(alike).withColumn("matched", F.col("matched") + F.col("_n")).drop("_n")
