"""Retrieval quality. ranked: (qid, id, rank), gold: (qid, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import active_status
from plinth.operators.ranking import weight_of

# Grades by intent and role; an adr is active or inactive by its status.
GRADES = {
    "orientation": {"adr_active": 3, "adr_inactive": 1, "research": 2, "reference": 2, "plan": 1, "exec": 1, "audit": 1, "code": 0},
    "debugging": {"adr_active": 1, "adr_inactive": 1, "research": 1, "reference": 1, "plan": 1, "exec": 3, "audit": 2, "code": 2},
    "implementation": {"adr_active": 2, "adr_inactive": 1, "research": 1, "reference": 1, "plan": 3, "exec": 2, "audit": 1, "code": 1},
}


def grade_for(intent: str, doc_type: Column, status: Column, on_topic: Column) -> Column:
    kind = F.lower(F.trim(doc_type))
    role = F.when(kind == "adr", F.when(active_status(status), "adr_active").otherwise("adr_inactive")).when(kind == "codebase", "code").otherwise(kind)
    grade = F.lit(0)
    for name, g in GRADES.get(intent, {}).items():
        grade = F.when(role == name, g).otherwise(grade)
    return F.when(on_topic, grade).otherwise(0)


def graded(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    return ranked.join(gold, ["qid", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ndcg(ranked: DataFrame, gold: DataFrame, k: int, own: DataFrame | None = None) -> DataFrame:
    """(qid, ndcg) of all queries in gold; 0 without a positive grade. own: gold's rows that are in ranked, where these are known without a join."""
    got = graded(ranked.filter(F.col("rank") <= k), gold if own is None else own).groupBy("qid").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    counts = gold.groupBy("qid", "grade").agg(F.count("*").alias("n"))  # grades are few, rows of gold may be many
    top = F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False), lambda g: F.array_repeat(g["grade"], F.least(g["n"], F.lit(k)).cast("int")))), 1, k)
    best = counts.groupBy("qid").agg(F.aggregate(F.transform(top, lambda g, i: _gain(g, i + 1)), F.lit(0.0), lambda a, x: a + x).alias("ideal"))
    return best.join(got, "qid", "left").select("qid", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def first_rank(ranked: DataFrame, gold: DataFrame, least: int = 1) -> DataFrame:
    """(qid, first, mrr): the first rank of a grade of least or more, null and 0 without one."""
    first = F.min(F.when(F.col("grade") >= least, F.col("rank")))
    return graded(ranked, gold).groupBy("qid").agg(first.alias("first")).withColumn("mrr", F.coalesce(1.0 / F.col("first"), F.lit(0.0)))


def at_k(ranked: DataFrame, gold: DataFrame, k: int, authoritative: int = 3, role: int = 2) -> DataFrame:
    """(qid, authoritative, precision): whether the first k have the highest grade, and the share of k places with grade role or more."""
    top = graded(ranked, gold).filter(F.col("rank") <= k)
    return top.groupBy("qid").agg(F.max(F.col("grade") >= authoritative).alias("authoritative"), (F.sum((F.col("grade") >= role).cast("int")) / F.lit(k)).alias("precision"))


__all__ = ["GRADES", "at_k", "first_rank", "grade_for", "graded", "ndcg", "weight_of"]
