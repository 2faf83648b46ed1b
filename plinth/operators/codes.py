"""Search over vector codes: a coarse index of inverted lists, int8 codes, and exact scores for what is left.

Centres are fitted by k-means on a bounded sample of the vectors; every vector goes to its nearest centre's list, as eight
bits for each component of its difference from the centre, and in a folder of the list's number. A query reads the lists of its nearest centres alone, so that the
others' files aren't opened; it keeps a surplus of rows by the codes' scores, whose own vectors then give the result. The
number of lists that a query reads is measured when the index is fitted: as many as find TARGET of the exact neighbours of
held-out sample vectors within the sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.retrieval import checked_broadcast, dot, norm, ranked

#: Vectors that centres are fitted on, at most, and of these the ones that are held out to measure.
SAMPLE, HELD_OUT = 20_000, 300
MOST_CENTRES, STEPS = 4096, 12
TARGET, SURPLUS = 0.985, 4
#: Rows of a list, and queries, that meet in one task.
PART_ROWS, QUERY_ROWS = 50_000, 2048


def _units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def k_means(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """k unit centres of unit vectors; a centre without vectors goes to one that is far from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        score = x @ centres.T
        own = score.argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        empty = np.bincount(own, minlength=k) == 0
        if empty.any():
            total[empty] = x[np.argsort(score.max(axis=1))[: int(empty.sum())]]
        centres = _units(total)
    return centres


def probes_for(x: np.ndarray, held: np.ndarray, centres: np.ndarray, limit: int, target: float) -> int:
    """The fewest lists that hold target of the limit nearest vectors in x of held."""
    own = (x @ centres.T).argmax(axis=1)
    score = held @ x.T
    near = np.argsort(-score, axis=1)[:, :limit]
    place = np.argsort(np.argsort(-(held @ centres.T), axis=1), axis=1)  # of each list in a query's order
    at = np.take_along_axis(place, own[near], axis=1)
    share = np.cumsum(np.bincount(at.ravel(), minlength=len(centres))) / at.size
    return min(len(centres), int(np.searchsorted(share, target)) + 1)


@dataclass
class CodedIndex:
    """Stored by build(): lists/list=n/ of (id, part, scale, codes), and the meta file."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int
    parts: dict[int, int]
    kind: str

    def lists(self, wanted: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"id {self.kind}, scale float, codes binary, part int, list int").parquet(f"{self.path}/lists")
        return rows if wanted is None else rows.filter(F.col("list").isin(wanted))

    def asked(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(list, qid, unit) of (qid, query): once for each of a query's nearest lists. Null vectors and those of another width are left out."""
        centres, n = self.centres, min(len(self.centres), probes or self.probes)
        width = centres.shape[1] if centres.size else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = _rows(b.column(1), width)
                near = np.argsort(-(x @ centres.T), axis=1)[:, :n]
                rows = np.repeat(np.arange(len(at)), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(at[rows])), _binary(x.astype(np.float32)[rows])], names=["list", "qid", "unit"])

        kind = queries.schema["qid"].dataType.simpleString()
        return queries.filter("query is not null").select("qid", F.col("query").cast("array<double>")).mapInArrow(run, f"list int, qid {kind}, unit binary")

    def near(self, queries: DataFrame, surplus: int, probes: int | None = None) -> DataFrame:
        """(qid, id, score, rank): the surplus best rows of each query by codes."""
        asked = self.asked(queries, probes)
        wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # MOST_CENTRES at most
        rows = self.lists(wanted)
        many = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        parts = self.spark.createDataFrame([(k, v) for k, v in self.parts.items() if k in set(wanted)], "list int, parts int")
        left = rows.join(F.broadcast(many), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "part", "block", "id", "scale", "codes")
        right = asked.join(F.broadcast(many), "list").join(F.broadcast(parts), "list").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "block", "qid", "unit")
        centres, width = self.centres, self.centres.shape[1]

        def score(own: pa.Table, theirs: pa.Table) -> pa.Table:
            if not own.num_rows or not theirs.num_rows:
                return pa.table({"qid": theirs.column("qid").slice(0, 0), "id": own.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.int8).reshape(-1, width)
            units = np.frombuffer(b"".join(theirs.column("unit").to_pylist()), np.float32).reshape(-1, width)
            centre = centres[own.column("list")[0].as_py()].astype(np.float32)
            got = (codes.astype(np.float32) @ units.T) * own.column("scale").to_numpy()[:, None] + units @ centre
            n = min(surplus, len(got))
            top = np.argpartition(-got, n - 1, axis=0)[:n]
            query = np.broadcast_to(np.arange(len(units)), top.shape)
            return pa.table({"qid": theirs.column("qid").take(pa.array(query.ravel())), "id": own.column("id").take(pa.array(top.ravel())), "score": pa.array(got[top, query].ravel().astype(np.float64))})

        out = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
        keys = ["list", "part", "block"]
        return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, out), surplus)

    def search(self, table: DataFrame, queries: DataFrame, limit: int, places: int | None = None, probes: int | None = None, surplus: int = SURPLUS) -> DataFrame:
        """(qid, id, score, rank): by cosine, as retrieval.dense_leg gives it, of the rows that the codes leave. table: (id, vector)."""
        kept = self.near(queries, surplus * limit, probes).select("qid", "id")
        both = table.join(kept, "id").join(checked_broadcast(queries.select("qid", "query")), "qid")
        cosine = dot(F.col("vector"), F.col("query")) / (norm(F.col("vector")) * norm(F.col("query")))
        return ranked(both.select("qid", "id", (cosine if places is None else F.round(cosine, places)).alias("score")), limit)


def _rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of those of the width, without nulls or infinities."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], _units(x[good])


def _binary(x: np.ndarray) -> pa.Array:
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * step).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def build(table: DataFrame, path: str, limit: int = 20, target: float = TARGET, sample: int = SAMPLE) -> CodedIndex:
    """An index of (id, vector) at path, over every row whose vector isn't null, zero or of another width than most of the sample."""
    spark, kind = table.sparkSession, table.schema["id"].dataType.simpleString()
    count = table.count()
    some = table.filter("vector is not null").select(F.col("vector").cast("array<double>").alias("vector"))
    some = some.sample(min(1.0, 1.2 * sample / max(1, count)), seed=3).limit(sample) if count > sample else some
    vectors = some.toArrow().column(0).combine_chunks()
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False) if len(vectors) else np.zeros(0, int)
    width = int(np.bincount(widths).argmax()) if len(widths) else 1
    _, x = _rows(vectors, width) if len(vectors) else (None, np.zeros((0, width)))
    k = max(1, min(MOST_CENTRES, math.isqrt(count), len(x) // 8 or 1))
    centres = k_means(x, k) if len(x) else np.zeros((1, width))
    held = x[np.random.default_rng(9).permutation(len(x))[:HELD_OUT]]
    probes = probes_for(x, held, centres, limit, target) if len(x) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, units = _rows(b.column(1), width)
            lists = (units @ centres.T).argmax(axis=1).astype(np.int32) if len(units) else np.zeros(0, np.int32)
            rest = units - centres[lists]  # what the centre leaves over, so that steps are fine in a tight list
            scale = np.abs(rest).max(axis=1) / 127 if len(units) else np.zeros(0)
            codes = np.rint(rest / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(lists), pa.array(scale.astype(np.float32)), _binary(codes)], names=["id", "list", "scale", "codes"])

    coded = table.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"id {kind}, list int, scale float, codes binary")
    coded.write.option("compression", "zstd").parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    parts = {r["list"]: math.ceil(r["n"] / PART_ROWS) for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each centre
    sizes = F.create_map(*(F.lit(v) for pair in parts.items() for v in pair)) if parts else None
    dealt = coded.withColumn("part", F.pmod(F.xxhash64("id"), sizes[F.col("list")]).cast("int") if parts else F.lit(0))
    dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.partitionBy("list").option("compression", "zstd").parquet(f"{path}/lists")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/coded")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    meta = json.dumps({"probes": probes, "parts": parts, "centres": centres.tolist(), "kind": kind})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
    return CodedIndex(spark, path, centres, probes, parts, kind)


def load(spark: SparkSession, path: str) -> CodedIndex:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return CodedIndex(spark, path, np.array(meta["centres"]), meta["probes"], {int(k): v for k, v in meta["parts"].items()}, meta["kind"])
