"""Run ledger checks as relational queries: contiguity, anti joins, history, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broken_segments(segments: DataFrame, key: str) -> DataFrame:
    """Keys whose segments (key, ordinal, last) aren't 0 to n - 1 once each with the last one flagged, and it alone."""
    n = F.count("*")
    facts = segments.groupBy(key).agg(n.alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.sum("ordinal").alias("total"), F.sum(F.col("last").cast("int")).alias("ends"), F.max(F.when(F.col("last"), F.col("ordinal"))).alias("end_at"))
    good = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("total") == F.col("n") * (F.col("n") - 1) / 2) & (F.col("ends") == 1) & F.coalesce(F.col("end_at") == F.col("n") - 1, F.lit(False))
    return facts.filter(~good).select(key, "n", "lo", "hi")


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left that right has no match for (NOT EXISTS, LEFT JOIN ... IS NULL)."""
    return left.join(right.select(*on), on, "left_anti")


def with_exists(left: DataFrame, name: str, right: DataFrame, on: list[str]) -> DataFrame:
    """left with a flag whether right has a match."""
    return left.join(right.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def retained(history: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The keep newest rows of each group."""
    return history.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def readiness(files: DataFrame, units: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(check, failures): the five checks before a run may be published.

    files: (key, state, expected), units: (key, ordinal, last), points: (key, id). A deleted file must have no unit, a kept
    one its expected number of points, and no point may lack a file.
    """
    kept, gone = files.filter("state <> 'deleted'"), files.filter("state = 'deleted'")
    counted = kept.join(points.groupBy(key).agg(F.count("*").alias("n")), key, "left").filter(F.coalesce("n", F.lit(0)) != F.col("expected"))
    checks = {"contiguous": broken_segments(units, key), "counts": counted, "no_units": missing(kept, units, [key]), "no_file": missing(points, files, [key]), "overlap": gone.join(units.select(key).distinct(), key, "left_semi")}
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def completion(units: DataFrame, by: list[str]) -> DataFrame:
    """Counts and bounds with conditional maxima in one pass. units: (by, ordinal, last, size)."""
    return units.groupBy(*by).agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.sum("size").alias("size"), F.max(F.when(F.col("last"), F.col("ordinal"))).alias("end_at"))


def unconfirmed(files: DataFrame, state: str) -> DataFrame:
    return files.agg(F.count_if(F.col("state") != state).alias("unconfirmed"))


def deltas_by_path(deltas: DataFrame, path: str) -> DataFrame:
    """Changes from a path and those that lead to it from elsewhere. deltas: (path, target, kind)."""
    return deltas.filter(F.col("path") == path).unionAll(deltas.filter((F.col("target") == path) & (F.col("path") != path)))


def fold_deltas(deltas: DataFrame, by: str) -> DataFrame:
    """Signed sums (by, identities, points); a negative total raises an error when it is read."""
    total = deltas.groupBy(by).agg(F.sum("identities").alias("identities"), F.sum("points").alias("points"))
    bad = (F.col("identities") < 0) | (F.col("points") < 0)
    return total.withColumn("points", F.when(bad, F.raise_error(F.lit("more was removed than is there")).cast("long")).otherwise(F.col("points")))


def rank_donors(candidates: DataFrame, root: str, backend: str) -> DataFrame:
    """Donors other than root of one backend: the same family first, then the latest, then by prefix. candidates: (root, backend, family, last_indexed, prefix)."""
    rows = candidates.filter((F.col("root") != root) & (F.col("backend") == backend))
    order = Window.orderBy("family", F.desc("last_indexed"), "prefix")  # a list of namespaces, not of rows
    return rows.withColumn("rank", F.row_number().over(order))


def failed_gates(candidates: DataFrame, gates: dict) -> DataFrame:
    """candidates with the names of the gates (name: condition that must hold) that they fail."""
    return candidates.withColumn("failed", F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()))))
