"""A deterministic corpus of records with needles, statuses and links; and whether a root is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import DOC_TYPES

FEATURES = ("search", "index", "cache", "watch")
CYCLE = ("proposed", "superseded", "accepted", "accepted")


def vault_corpus(spark: SparkSession, n: int = 24, density: float = 0.3, seed: int = 42) -> DataFrame:
    """(key, doc_type, feature, needle, status, related, content): types and features in turn, links by hashes of pairs."""
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, DOC_TYPES)), (i % 6 + 1).cast("int"))
    feature = F.element_at(F.array(*map(F.lit, FEATURES)), (i % 4 + 1).cast("int"))
    nth = F.floor(i / 6)
    status = F.when(kind != "adr", "").when(nth == 0, "").otherwise(F.element_at(F.array(*map(F.lit, CYCLE)), ((nth - 1) % 4 + 1).cast("int")))
    number = F.lpad(i.cast("string"), F.greatest(F.length(i.cast("string")), F.lit(3)), F.lit("0"))  # at least three digits, and all of them
    key = F.concat(kind, F.lit("/2026-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("-"), feature, F.lit("-test-"), number)
    needle = F.concat(F.lit("NEEDLE_"), F.upper(kind), F.lit("_"), number)
    near = F.filter(F.sequence(F.greatest(i - 5, F.lit(0)), F.greatest(i - 1, F.lit(0))), lambda j: (j < i) & (F.pmod(F.xxhash64(i, j, F.lit(seed)), F.lit(1000)) < int(density * 1000)))
    base = spark.range(n).select("id", kind.alias("doc_type"), feature.alias("feature"), status.alias("status"), key.alias("key"), needle.alias("needle"), near.alias("near"))
    mark = F.when(F.col("status") != "", F.concat(F.lit(" | (**status:** `"), "status", F.lit("`)"))).otherwise("")
    related = F.array_join(F.transform("near", lambda j: F.concat(F.lit("n"), j.cast("string"))), ", ")
    content = F.concat(F.lit("---\ntype: "), "doc_type", F.lit("\ntags: ['#"), "doc_type", F.lit("', '#"), "feature", F.lit("']\nrelated: ["), related, F.lit("]\n---\n# "), "feature", F.lit(" "), F.col("id").cast("string"), mark, F.lit("\nA paragraph on "), "feature", F.lit(".\n\nIts needle is "), "needle", F.lit(".\n"))
    return base.select("key", "doc_type", "feature", "needle", "status", F.col("near").alias("related"), content.alias("content"))


def root_status(roots: DataFrame, top: str) -> DataFrame:
    """roots (root, a folder below top) with status: live, orphaned, or unverifiable for none. Folders are listed once, by the file system of top."""
    spark = roots.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = spark.createDataFrame([(f"{top}/{s.getPath().getName()}", True) for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.isDirectory()], "root string, _there boolean")
    status = F.when(F.coalesce("root", F.lit("")) == "", "unverifiable").when(F.col("_there"), "live").otherwise("orphaned")
    return roots.join(there, "root", "left").withColumn("status", status).drop("_there")
