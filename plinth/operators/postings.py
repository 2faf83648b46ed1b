"""Stored postings with block maxima, and top-k searches that skip blocks.

Texts are dealt to blocks of DOCS texts of like weight (the sum of their terms' weights), so that a block's largest weights
say something about each of its texts. Rows lie by block and term, in files of a size by bytes; beside them are each
block's terms with their largest weight. A search adds these up to a bound for each query and block, scores the blocks of
the highest bounds, and from then on only those whose bound reaches the query's limit-th best score so far. No text that
belongs to the result is in a block that is skipped.

A file is one row group of whole blocks in their order, so a task that reads it scores a block's texts without a shuffle
and passes on each query's best rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.operators.retrieval import MOST_BROADCAST, PAIRS, Best, checked_broadcast, ranked

DOCS = 128
#: Rows of a file, about 8 MB of them: what a task sorts and holds, at any size of the index.
FILE_ROWS = 1_000_000
#: Bytes of files or of a shuffle that a task reads when postings are stored: it holds their bounds, and sorts what it deals to more than 200 others.
SPLIT = 16 << 20
#: Blocks of a query that each round scores, at most; the last round has no bound.
ROUNDS = (8,)
#: Blocks or terms named in a filter, and (query, block, term) rows broadcast, about 50 MB, at most; beyond these rows are joined.
MOST_NAMED, MOST_HELD = 1000, 1_000_000
#: Weight classes for each doubling of a text's weight; classes are few whatever the corpus.
CLASSES = 4


@dataclass
class Index:
    """Stored by store(): rows (block, term, id, weight, payload) and bounds (block, term, most, n)."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bounds")

    def postings(self) -> DataFrame:
        return self.rows().drop("block")

    def top(self, query_terms: DataFrame, limit: int, places: int | None = None, where: Column | None = None, ids: DataFrame | None = None, rounds: tuple[int, ...] = ROUNDS, read: list[DataFrame] | None = None) -> DataFrame:
        """(qid, id, score, rank): of each query of (qid, term, q) the limit best texts by dot product over shared terms; ties go by id.

        where: of rows and their payload; ids: (id), of which texts alone count. read: gets what each round reads, (qid, block, term, q, n).
        """
        queries = _written(query_terms.select("qid", "term", "q"), "queries")
        few = [r["term"] for r in queries.select("term").distinct().limit(MOST_NAMED + 1).collect()]
        bounds = self.bounds()
        bounds = bounds.filter(F.col("term").isin(few)) if len(few) <= MOST_NAMED else bounds  # row groups of other terms aren't read
        met = bounds.join(checked_broadcast(queries), "term")
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
        blocks = met.groupBy("qid", "block").agg(F.sum(F.col("q") * F.col("most")).alias("bound"))
        blocks = _written(blocks.withColumn("nth", F.row_number().over(order)), "blocks")
        slack = 10.0**-places if places is not None else 0.0
        asked = _Queries.of(queries)
        scores, done = None, 0
        for most in [*rounds, None]:
            left = blocks.filter(F.col("nth") > done)
            left = left.filter(F.col("nth") <= done + most) if most else left
            least = None
            if scores is not None:
                least = scores.filter(F.col("rank") == limit).select("qid", F.col("score").alias("least"))  # a row a query
                left = left.join(least, "qid", "left").filter(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) + slack >= F.col("least")))
            left = _written(left.select("qid", "block"), "left")
            done += most or 0
            if not (there := left.count()):
                continue
            if read is not None or asked is None:
                wanted = _written(met.join(F.broadcast(left) if there <= MOST_HELD else left, ["qid", "block"]).select("qid", "block", "term", "q", "n"), "wanted")
                if read is not None:
                    read.append(wanted)
            if asked is None:
                fresh = self._joined(wanted, places, where, ids)
            else:
                fresh = self._scored(asked, left, most is not None, least, limit, places, where, ids)
            # A task takes what a query's bounds allow, which may be a block again that an earlier round has scored.
            scores = fresh if scores is None else scores.drop("rank").unionByName(fresh).dropDuplicates(["qid", "id"])
            scores = _written(ranked(scores, limit), "scores")
        return scores if scores is not None else ranked(self._joined(met.limit(0), places, where, ids), limit)

    def _scored(self, asked: _Queries, left: DataFrame, few: bool, least: DataFrame | None, limit: int, places: int | None, where: Column | None, ids: DataFrame | None) -> DataFrame:
        """Block by block in the tasks that read them. few: left has a few blocks a query, which are named; else a block counts for the queries whose least (qid, least) its bound reaches."""
        rows = self.rows()
        blocks = left.select("block").distinct()
        named = [r["block"] for r in blocks.limit(MOST_NAMED + 1).collect()]
        # Neither a filter nor a broadcast join moves a row, so blocks stay whole and in order.
        if len(named) <= MOST_NAMED:
            rows = rows.filter(F.col("block").isin(named))
        elif blocks.count() <= MOST_BROADCAST:
            rows = rows.join(F.broadcast(blocks), "block", "left_semi")
        rows = rows if where is None else rows.filter(where)
        kind = rows.schema["id"].dataType.simpleString()
        score = _score_blocks(asked, asked.pairs(left) if few else None, asked.least(least), limit if ids is None else None, places)
        terms = rows.sparkSession.createDataFrame(pa.table({"term": asked.terms, "t": np.arange(len(asked.terms))}))
        hits = rows.join(F.broadcast(terms), "term").select("block", "t", "id", "weight").mapInArrow(score, f"qid {asked.kind}, id {kind}, score double")
        return hits if ids is None else hits.join(checked_broadcast(ids.select("id").distinct()), "id", "left_semi").select("qid", "id", "score")

    def _joined(self, wanted: DataFrame, places: int | None, where: Column | None, ids: DataFrame | None) -> DataFrame:
        """By joins, for queries of so many terms that tasks can't hold them."""
        rows = self.rows()
        rows = rows if where is None else rows.filter(where)
        rows = rows if ids is None else rows.join(checked_broadcast(ids.select("id").distinct()), "id", "left_semi")
        hits = rows.join(checked_broadcast(wanted.select("qid", "block", "term", "q"), MOST_HELD), ["block", "term"])
        score = F.sum(F.col("weight") * F.col("q"))
        return hits.groupBy("qid", "id").agg((score if places is None else F.round(score, places)).alias("score"))


@dataclass
class _Queries:
    """Queries' terms as arrays: of term t, rows starts[t] to starts[t + 1] of query (a number, of qids) and q."""

    qids: pa.Array
    kind: str
    terms: pa.Array
    starts: np.ndarray
    query: np.ndarray
    q: np.ndarray

    @staticmethod
    def of(queries: DataFrame) -> _Queries | None:
        """None if they have more than MOST_BROADCAST rows."""
        if queries.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
            return None
        own = queries.filter("qid is not null and term is not null").toArrow().combine_chunks()
        own = own.sort_by("term")
        qids, terms = (own.column(c).combine_chunks().dictionary_encode() if own.num_rows else pa.array([], own.schema.field(c).type).dictionary_encode() for c in ("qid", "term"))
        t = terms.indices.to_numpy(zero_copy_only=False)
        return _Queries(qids.dictionary, queries.schema["qid"].dataType.simpleString(), terms.dictionary, np.searchsorted(t, np.arange(len(terms.dictionary) + 1)), qids.indices.to_numpy(zero_copy_only=False).astype(np.int64), own.column("q").to_numpy().astype(np.float64))

    def _numbers(self, qids: pa.ChunkedArray) -> np.ndarray:
        return pa.compute.index_in(qids, value_set=self.qids).to_numpy().astype(np.int64)

    def pairs(self, left: DataFrame) -> dict[int, np.ndarray]:
        """Of left's blocks the queries; left has a few rows a query."""
        own = left.toArrow()
        block, query = own.column("block").to_numpy(), self._numbers(own.column("qid"))
        order = np.argsort(block, kind="stable")
        at = np.flatnonzero(np.diff(block[order], prepend=np.iinfo(np.int64).min)) if len(block) else []
        return dict(zip(block[order][at].tolist(), np.split(query[order], at[1:]), strict=True)) if len(block) else {}

    def least(self, least: DataFrame | None) -> np.ndarray:
        out = np.full(len(self.qids), -np.inf)
        if least is not None:
            own = least.toArrow()  # a row a query
            out[self._numbers(own.column("qid"))] = own.column("least").to_numpy()
        return out


def _score_blocks(asked: _Queries, pairs: dict[int, np.ndarray] | None, least: np.ndarray, limit: int | None, places: int | None):
    """(qid, id, score) of rows (block, t, id, weight) by block. pairs: of each block the queries; else those whose least the block's bound reaches. limit: of each query and task so many rows; None: all."""
    slack = 10.0**-places if places is not None else 0.0
    n = len(asked.qids)

    def one(block: int, t: np.ndarray, ids: pa.Array, weight: np.ndarray, best: Best | None) -> Iterator[pa.RecordBatch]:
        named = ids.dictionary_encode()
        doc, names = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), named.dictionary
        wants = np.zeros(n, bool)
        if pairs is not None:
            wants[pairs.get(block, [])] = True
        else:
            most = np.zeros(len(asked.terms))
            np.maximum.at(most, t, weight)
            bound = np.bincount(asked.query, asked.q * np.repeat(most, np.diff(asked.starts)), n)
            wants = bound * (1 + 1e-9) + slack >= (np.maximum(least, best.least) if best else least)
        keep = wants[asked.query]  # only these queries' terms count
        before = np.concatenate([[0], np.cumsum(keep)])
        starts, query, q = before[asked.starts], np.cumsum(wants)[asked.query[keep]] - 1, asked.q[keep]
        asking = np.flatnonzero(wants)
        count = starts[t + 1] - starts[t]
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            return
        total, hit = np.zeros(len(asking) * len(names)), np.zeros(len(asking) * len(names), bool)
        at = 0
        while at < len(t):  # PAIRS of rows and queries at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            c = count[at:to]
            entry = np.repeat(starts[t[at:to]] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            cell = query[entry] * len(names) + np.repeat(doc[at:to], c)
            total += np.bincount(cell, np.repeat(weight[at:to], c) * q[entry], len(total))
            hit[cell] = True
            at = to
        score = np.round(total, places) if places is not None else total
        cells = np.flatnonzero(hit & (score >= np.repeat((np.maximum(least, best.least) if best else np.full(n, -np.inf))[asking], len(names))))
        found, own = asking[cells // len(names)], names.take(pa.array(cells % len(names)))
        if best is not None:
            best.add(found, own, score[cells])
        elif len(cells):
            yield pa.RecordBatch.from_arrays([asked.qids.take(pa.array(found)), own, pa.array(score[cells])], names=["qid", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, now = Best(n, limit) if limit is not None else None, [], None

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                yield from one(now, whole.column(1).to_numpy(), whole.column(2).combine_chunks(), whole.column(3).to_numpy(), best)

        for b in batches:
            block = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop > start:
                    if block[start] != now:
                        yield from end()
                        now = block[start]
                    held.append(b.slice(start, stop - start))
        yield from end()
        if best is not None:
            yield from best.named(asked.qids)

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    from plinth.sources.files import scratch

    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(postings: DataFrame, path: str, docs: int = DOCS) -> Index:
    """Writes postings (id, term, weight, and payload; one row for an id and term) for searches. postings are run once, and then read from a copy.

    A column total, the sum of a text's weights, spares a join: its rows find their blocks by themselves.
    """
    spark = postings.sparkSession
    postings.write.option("compression", "lz4").parquet(f"{path}/staged")
    small = spark.newSession()  # with splits of its own
    small.conf.set("spark.sql.files.maxPartitionBytes", SPLIT)
    staged = small.read.schema(postings.schema).parquet(f"{path}/staged")
    own = "total" in staged.columns
    weight = F.max("total") if own else F.sum("weight")
    texts = _written(staged.groupBy("id").agg(_class(weight).alias("class"), F.count("*").alias("n"), (F.min("total") if own else F.lit(0.0)).alias("less"), weight.alias("more")), "texts")
    sizes = texts.groupBy("class").agg(F.count("*").alias("texts"), F.sum("n").alias("rows"), F.count_if(F.col("less") < F.col("more")).alias("differ")).collect()  # a row for each doubling's share
    if own and not any(r["differ"] for r in sizes):
        classed = staged.withColumn("class", _class(F.col("total"))).drop("total")
    else:  # an id's texts lie in one block, also where several have it
        classed = staged.drop("total").join(checked_broadcast(texts.select("id", "class")), "id")
    parts = max(1, math.ceil(sum(r["rows"] for r in sizes) / FILE_ROWS), min(8, sum(r["texts"] for r in sizes) // docs + 1))
    within = F.lit(1)
    for r in sizes:
        within = F.when(F.col("class") == r["class"], F.lit(math.ceil(r["texts"] / docs))).otherwise(within)
    placed = classed.withColumn("block", F.col("class").cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), within)).drop("class")
    # One row group a file, and no second file of a task: a file's rows are never dealt to two tasks.
    whole = {"compression": "zstd", "parquet.block.size": 1 << 30, "maxRecordsPerFile": 0}
    placed.repartition(parts, "block").sortWithinPartitions("block", "term").write.options(**whole).parquet(f"{path}/rows")
    small.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SPLIT)
    small.conf.set("spark.sql.shuffle.partitions", max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = small.read.parquet(f"{path}/rows")
    bounds = rows.groupBy("block", "term").agg(F.max("weight").alias("most"), F.count("*").alias("n"))
    bounds.repartition(max(1, parts // 2), "term").sortWithinPartitions("term").write.options(**{"compression": "zstd", "parquet.block.size": 8 << 20}).parquet(f"{path}/bounds")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/staged")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return Index(spark, path)


def _class(total: Column) -> Column:
    return F.floor(F.log2(total) * CLASSES).cast("int")
