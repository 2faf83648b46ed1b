"""Ranked retrieval: dense and sparse legs, their fusion, and feedback vectors.

A leg is (qid, id, score, rank). Filters go on the table before the legs, so that both see the same rows. Row numbers are
limited by group before they are shuffled (Spark's WindowGroupLimit), so a leg moves at most tasks x limit rows a query.
Ranks start at 1; ties go by id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RRF_K = 60
LEG_FACTOR = 4
#: Queries and their terms are broadcast up to so many rows; more go by an ordinary join, or block by block.
MOST_BROADCAST = 100_000
#: Dense queries that a pass over the rows takes at once.
QUERY_BLOCK = 4096
#: Rows that meet a block of queries in one task, where there are several.
PART_ROWS = 100_000
#: Scores that are computed at once, 16 MB in each of some arrays.
PAIRS = 2_000_000


def checked_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; the count stops one over."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def leg_side(leg: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """A leg as a join's side: it has limit rows a query at most, so the queries tell whether it is broadcast, without running it first."""
    return F.broadcast(leg) if queries.select("qid").distinct().count() * limit <= MOST_BROADCAST else leg


def dot(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, places: int) -> Column:
    """x rounded with its sign kept, so that a small negative number becomes -0.0, as in other engines and numpy; Spark's own round gives 0.0."""
    return F.round(F.abs(x), places) * F.signum(x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length one; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """The limit best rows of each query, with rank."""
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


class Best:
    """Of candidates that come in parts, the limit best of each of n queries, by score and then id; least is the last one's score of the queries that have so many."""

    def __init__(self, n: int, limit: int):
        self.n, self.limit, self.least = n, limit, np.full(n, -np.inf)
        self.parts: list[pa.Table] = []
        self.more = 0

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        if len(query):
            self.parts.append(pa.table({"query": query, "id": ids, "score": score}))
            self.more += len(query)
            if self.more > self.limit * self.n:
                self.rows()

    def rows(self) -> pa.Table | None:
        """(query, id, score)."""
        if not self.parts:
            return None
        all_rows = pa.concat_tables(self.parts)
        all_rows = all_rows.take(pc.sort_indices(all_rows, [("query", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
        query = all_rows.column("query").to_numpy()
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(nth == self.limit - 1)
        self.least[query[last]] = all_rows.column("score").to_numpy()[last]
        self.parts, self.more = [all_rows.take(pa.array(np.flatnonzero(nth < self.limit)))], 0
        return self.parts[0]

    def named(self, qids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(qid, id, score)."""
        rows = self.rows()
        if rows is not None:
            yield from pa.table({"qid": qids.take(rows.column("query").combine_chunks()), "id": rows.column("id"), "score": rows.column("score")}).to_batches(max_chunksize=100_000)


def _add_best(best: Best, values: np.ndarray, ids: pa.Array, matrix: np.ndarray, own: np.ndarray, places: int | None) -> None:
    """The rows of greatest cosine for the queries of a matrix, which are best's own; PAIRS of rows and queries at a time."""
    lengths, step = np.linalg.norm(matrix, axis=1), max(1, PAIRS // len(matrix))
    for at in range(0, len(values), step):
        part = values[at : at + step]
        with np.errstate(all="ignore"):
            scores = (part @ matrix.T) / (np.linalg.norm(part, axis=1)[:, None] * lengths)
        if places is not None:
            scores = np.round(scores, places)
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        least = best.least[own]
        if len(scores) > best.limit and np.count_nonzero(scores >= least) > best.limit * len(matrix) // 4:
            least = np.maximum(least, -np.partition(-scores, best.limit - 1, axis=0)[best.limit - 1])
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        best.add(own[query], ids.take(pa.array(at + row)), scores[row, query])


def _of_width(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those of a width."""
    at = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == width)
    return at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _against_matrix(matrix: np.ndarray, qids: pa.Array, limit: int, places: int | None):
    """A task's best rows for the queries of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(matrix), limit)
        for b in batches:
            at, values = _of_width(b.column(1), matrix.shape[1])
            _add_best(best, values, b.column(0).take(pa.array(at)), matrix, np.arange(len(matrix)), places)
        yield from best.named(qids)

    return run


def _part_against_block(limit: int, places: int | None):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        best = Best(queries.num_rows, limit)
        if rows.num_rows and queries.num_rows:
            vectors, asked, ids = rows.column("vector").combine_chunks(), queries.column("query").combine_chunks(), rows.column("id").combine_chunks()
            for width in np.unique(asked.value_lengths().to_numpy(zero_copy_only=False)).tolist():
                (at, values), (own, matrix) = _of_width(vectors, width), _of_width(asked, width)
                if width and len(at):
                    _add_best(best, values, ids.take(pa.array(at)), matrix, own, places)
        empty = pa.table({"qid": queries.column("qid").slice(0, 0), "id": rows.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *(pa.Table.from_batches([b]) for b in best.named(queries.column("qid").combine_chunks()))])

    return run


def dense_leg(table: DataFrame, queries: DataFrame, limit: int, places: int | None = None) -> DataFrame:
    """By cosine. table: (id, vector), queries: (qid, query). Null vectors and those of another width are left out.

    QUERY_BLOCK queries at most are a matrix that all rows meet in one pass; a task passes on its best rows of each query
    only. More are dealt to blocks, and rows to parts of PART_ROWS, each pair of which meets in a task; no query goes
    through the driver then.
    """
    given = queries.filter("query is not null").select("qid", F.col("query").cast("array<double>").alias("query"))
    count = given.count()
    fields = f"qid {queries.schema['qid'].dataType.simpleString()}, id {table.schema['id'].dataType.simpleString()}, score double"
    rows = table.filter("vector is not null").select("id", "vector")
    if count > QUERY_BLOCK:
        blocks, parts = math.ceil(count / QUERY_BLOCK), max(1, math.ceil(rows.count() / PART_ROWS))
        left = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = given.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return ranked(left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_part_against_block(limit, places), fields), limit)
    own = given.toArrow()
    ids, vectors = own.column("qid").combine_chunks(), own.column("query").combine_chunks()
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False) if own.num_rows else np.zeros(0, int)
    legs = []
    for width in np.unique(widths[widths > 0]).tolist():
        at, matrix = _of_width(vectors, width)
        legs.append(rows.mapInArrow(_against_matrix(matrix, ids.take(pa.array(at)), limit, places), fields))
    if not legs:
        return ranked(rows.sparkSession.createDataFrame([], fields), limit)
    return ranked(reduce(DataFrame.unionByName, legs), limit)


def term_weights(texts: DataFrame, pattern: str = r"[a-z0-9]+", wanted: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """(id, term, weight, and texts' other columns): 1 + ln(count) of each term of (id, text), counted text by text, so nothing is shuffled; rows of an id that repeats each have their own. wanted: (term); others are left out. Null texts have none. totals: with total, the sum of a text's weights."""
    rest = [c for c in texts.columns if c not in ("id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts = [Counter(find(text.lower())) if text else {} for text in part.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(c) for c in counts]))
                n = np.fromiter((k for c in counts for k in c.values()), np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([t for c in counts for t in c], pa.string()), pa.array(1 + np.log(n)), *(part.column(i + 2).take(rows) for i in range(len(rest))), *([pa.array(np.bincount(rows, 1 + np.log(n), part.num_rows)[rows])] if totals else [])], names=["id", "term", "weight", *rest, *(["total"] if totals else [])])

    schema = T.StructType([texts.schema["id"]]).add("term", "string").add("weight", "double")
    for c in rest:
        schema = schema.add(texts.schema[c])
    schema = schema.add("total", "double") if totals else schema
    out = texts.select("id", "text", *rest).mapInArrow(run, schema)
    return out if wanted is None else out.join(checked_broadcast(wanted.select("term").distinct()), "term", "left_semi").select(schema.names)


def sparse_leg(postings: DataFrame, query_terms: DataFrame, limit: int, places: int | None = None) -> DataFrame:
    """By dot product over shared terms. postings: (id, term, weight); query_terms: (qid, term, q). Only rows that share a term appear."""
    hits = postings.join(checked_broadcast(query_terms), "term").groupBy("qid", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return ranked(hits.withColumn("score", F.round("score", places)) if places is not None else hits, limit)


def fuse(*legs: DataFrame, limit: int, k: int = RRF_K, places: int | None = None) -> DataFrame:
    """Reciprocal rank fusion. One leg alone keeps its own scores."""
    if len(legs) == 1:
        return legs[0].filter(F.col("rank") <= limit)
    both = legs[0].select("qid", "id", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("qid", "id", "rank"))
    total = F.sum(1.0 / (k + F.col("rank")))
    return ranked(both.groupBy("qid", "id").agg((F.round(total, places) if places is not None else total).alias("score")), limit)


def hybrid(table: DataFrame, queries: DataFrame, index, query_terms: DataFrame | None, limit: int, keep: Column | None = None, places: int | None = None, filtered: bool = False) -> DataFrame:
    """Both legs of LEG_FACTOR * limit rows over the rows of table that keep holds for, fused. index: stored postings (postings.Index), which hold other rows too where keep is given or table is filtered; without them the dense leg alone."""
    rows = table.filter(keep) if keep is not None else table
    dense = dense_leg(rows.select("id", "vector"), queries, LEG_FACTOR * limit, places)
    if index is None or query_terms is None:
        return fuse(dense, limit=limit)
    sparse = index.top(query_terms, LEG_FACTOR * limit, places, ids=rows.select("id") if filtered or keep is not None else None)
    return fuse(dense, sparse, limit=limit, places=places and places + 4)


def mean_vector(vectors: DataFrame, by: str = "qid") -> DataFrame:
    """(by, mean) of (by, vector), component by component."""
    parts = vectors.select(by, F.posexplode("vector").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))


def recommend(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(qid, query): the mean of positives, moved away from that of negatives by their difference; without negatives the mean. Both are (qid, vector)."""
    good, bad = mean_vector(positives), mean_vector(negatives).withColumnRenamed("mean", "bad")
    moved = F.when(F.col("bad").isNull(), F.col("mean")).otherwise(F.zip_with("mean", "bad", lambda a, b: a + (a - b)))
    return good.join(bad, "qid", "left").select("qid", moved.alias("query"))


def live_anchors(anchors: DataFrame, table: DataFrame) -> DataFrame:
    """Feedback anchors (qid, id) that still exist."""
    return anchors.join(table.select("id"), "id", "left_semi")


def head_point(documents: DataFrame, points: DataFrame) -> DataFrame:
    """(doc, point): the point of a document's first chunk, else the bare one's. points: (key, point)."""
    head = points.select(F.col("key").alias("head"), F.col("point").alias("p0"))
    bare = points.select(F.col("key").alias("doc"), F.col("point").alias("p1"))
    return documents.withColumn("head", F.concat("doc", F.lit("#c0"))).join(head, "head", "left").join(bare, "doc", "left").select("doc", F.coalesce("p0", "p1").alias("point"))


def _most(*values):
    """The largest, of numbers or of columns."""
    return F.greatest(*(v if isinstance(v, Column) else F.lit(v) for v in values)) if any(isinstance(v, Column) for v in values) else max(values)


def window_size(k, reranked: bool, globs: bool = False, code: bool = False):
    """Rows that a search takes from its legs before its later steps; k is a number or a column."""
    if code and globs:
        return _most(10 * k, 50)
    return _most(4 * k, 20) if reranked else 2 * k


def candidate_limit(k, legacy):
    capped = _most(legacy, 6 * k, 32)
    return _most(legacy, F.least(F.lit(64), capped) if isinstance(capped, Column) else min(64, capped))


def grown_windows(page: DataFrame, base: int, wanted: int) -> DataFrame:
    """(qid, taken) of (qid, rank, fits): the window that a search has doubled to when wanted rows in it fit, the page ends, or it reaches max(4 * base, 500)."""
    most = max(4 * base, 500)
    each = page.groupBy("qid").agg(F.count("*").alias("there"), F.collect_list(F.when(F.col("fits"), F.col("rank"))).alias("found"))  # a page's rows
    doubled = F.array(F.lit(base), *(F.least(F.lit(base << i), F.lit(most), F.greatest("there", F.lit(base))) for i in range(1, math.ceil(math.log2(most / base)) + 1)))
    enough = F.filter(doubled, lambda w: (F.size(F.filter("found", lambda r: r <= w)) >= wanted) | (w >= F.least("there", F.lit(most))))
    return each.select("qid", F.element_at(enough, 1).cast("long").alias("taken"))
