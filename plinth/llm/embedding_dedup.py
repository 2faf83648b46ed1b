"""Embedding near-dedup by sorted projection passes.

Vectors are centred by their label, so that a label whose vectors all lie close together is told apart as well as one that
is spread out. In each pass every vector gets a string of random sign bits (hyperplane hashes, concatenated); vectors are
ordered by it within their label, and each is compared with the next ones, over the edges of partitions too. Verified pairs
of all passes are united into components.

How many passes a label needs depends on its size and spread, so it is measured: some vectors of each label (PROBES, by
hash) are compared with all of the label, and the share of the links met there whose ends the passes have joined is the
recall. Labels under RECALL get more passes and wider windows, ROUNDS after another; a label for which these would cost
more than comparing its vectors block by block is compared that way, which finds every link.

Then every component is compared whole, in blocks, so that windows limit no vector's number of links: a link is missed only
if no chain of found pairs joins its two vectors. Equal vectors of one label are one point with a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common as C
from .graph import components

#: Passes and window of the first round, and of those for labels whose recall is under RECALL. After the last one, or where a label has at most 2 * passes * window vectors, blocks are compared whole.
ROUNDS = ((12, 32), (24, 128), (48, 512), (192, 512))
RECALL = 0.99
#: Vectors of each label whose links are looked for in the whole label, to measure recall: a bounded sample.
PROBES = 2000
#: Points in one block; a component of over MANY blocks has larger ones, up to LARGEST, so that its points are copied less often.
BLOCK, MANY, LARGEST = 1024, 64, 16384


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) by width."""
    width = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.r_[0, np.cumsum(width)[:-1]].astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield rows, flat[C.ranges(first[rows], np.full(len(rows), w))].reshape(len(rows), int(w))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very small or large components are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _binary_rows(x: np.ndarray) -> pa.Array:
    n, w = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w * 8).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _project(passes: int, seed: int):
    """Of (label, node, vector, mean)."""
    schema = pa.schema([("pass", pa.int32()), ("label", pa.int64()), ("width", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("unit", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in C.batches_of(batches, 4 << 20):
            labels, nodes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets, data = C.utf8_column(b.column(3))
            for rows, x in _matrices(b.column(2)):
                w = x.shape[1]
                unit = _unit(x)
                if w not in planes:
                    planes[w] = np.random.default_rng((seed, w)).standard_normal((passes * 63, w))
                mean = data[C.ranges(offsets[rows], np.full(len(rows), 8 * w))].view(np.float64).reshape(len(rows), w)
                bits = ((unit - mean) @ planes[w].T > 0).reshape(len(rows), passes, 63)
                keys = bits @ (np.int64(1) << np.arange(62, -1, -1, dtype=np.int64))
                stored = _binary_rows(unit)
                for p in range(passes):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(labels[rows]), pa.array(np.full(n, w, np.int32)), pa.array(keys[:, p]), pa.array(nodes[rows]), stored], schema=schema)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, width, n, sum of unit vectors) of (label, vector), by batch."""
    for b in batches:
        labels = b.column(0).to_numpy(zero_copy_only=False)
        for rows, x in _matrices(b.column(1)):
            order = np.argsort(labels[rows], kind="stable")
            start, many = C.runs(labels[rows][order])
            total = np.add.reduceat(_unit(x)[order], start, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(labels[rows][order][start]), pa.array(np.full(len(start), x.shape[1], np.int32)), pa.array(many), _binary_rows(total)], names=["label", "width", "n", "total"])


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, width, n, mean) of rows of _sums, which come sorted by label and width."""
    held: list | None = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([held[2]], pa.int64()), pa.array([(held[3] / held[2]).tobytes()])], names=["label", "width", "n", "mean"])

    for b in batches:
        for label, width, n, total in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[:2] == [label, width]:
                held[2] += n
                held[3] = held[3] + np.frombuffer(total)
            else:
                if held:
                    yield done()
                held = [label, width, n, np.frombuffer(total)]
    if held:
        yield done()


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of the linked sets of links: as many pairs as nodes, however dense the links are."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        for x in (i, j, root[i], root[j]):
            np.minimum.at(after, x, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


_FOUND = "a long, b long, edge int, pass int, label long, width int, side int, unit binary"


def _window_pairs(window: int, least: float, edges: bool):
    """Rows (edge, pass, label, width, node, unit) come sorted by group and key. Links go out as stars (a, b).

    edges: also the first and last rows of a partition, under the number of the edge that they lie at, so that they meet
    their neighbours behind it in a second call.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int32()), ("pass", pa.int32()), ("label", pa.int64()), ("width", pa.int32()), ("side", pa.int32()), ("unit", pa.binary())])

    def edge_rows(part: int, side: int, name: tuple, x: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        fixed = [pa.array(np.full(n, v, kind)) for v, kind in ((part, np.int32), (name[1], np.int32), (name[2], np.int64), (name[3], np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(n)), *fixed, pa.array(np.full(n, side, np.int32)), _binary_rows(x)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last rows of a group wait for its next rows."""
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        opening: list[tuple] = []  # the first group's first rows
        opened = False
        for b in batches:
            group = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            nodes = b.column(4).to_numpy(zero_copy_only=False)
            offsets, data = C.utf8_column(b.column(5))
            cut = np.r_[0, np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, len(group)] if len(group) else [0]
            left, right = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                name = tuple(group[s])
                x, ids = data[offsets[s] : offsets[e]].view(np.float64).reshape(e - s, name[3]), nodes[s:e]
                if edges and not opened:
                    if opening and opening[0][0] != name:
                        opened = True
                    elif sum(len(o[2]) for o in opening) < window:
                        opening.append((name, x[:window].copy(), ids[:window].copy()))
                    else:
                        opened = True
                known = 0
                if held and held[0] == name:
                    known = len(held[2])
                    x, ids = np.r_[held[1], x], np.r_[held[2], ids]
                for at in range(0, len(x), 256):
                    to = min(at + 256, len(x))
                    i, j = np.nonzero(x[at:to] @ x[at : to + window].T >= least)
                    good = (j > i) & (j - i <= window) & (at + j >= known)
                    left.append(ids[at + i[good]])
                    right.append(ids[at + j[good]])
                held = (name, x[-window:].copy(), ids[-window:].copy())
            if left:
                a, c = _stars(np.concatenate(left), np.concatenate(right))
                none = [pa.nulls(len(a), f.type) for f in list(schema)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), *none], schema=schema)
        if edges and held:
            first = (np.concatenate([o[1] for o in opening])[:window], np.concatenate([o[2] for o in opening])[:window])
            yield edge_rows(part - 1, 1, opening[0][0], *first)
            yield edge_rows(part, 0, *held)

    return run


#: Rows of a product of two blocks that are there at once.
TILE = 256


def _block_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows that agree in the first keys columns, by which they come sorted, as one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        names = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], axis=1)
        cut = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, len(names)] if len(names) else [0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if held and any(held[0].column(i)[0] != b.column(i)[int(s)] for i in range(keys)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(int(s), int(e - s)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _block_links(least: float, sampled: bool):
    """(a, b) of rows (label, width, lo, hi, right, node, unit), a pair of blocks at a time: stars of all links, or one link of each right row if sampled."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _block_rows(batches, 4):
            right, nodes = (rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            offsets, data = C.utf8_column(rows.column(6))
            x = data[offsets[0] : offsets[-1]].view(np.float64).reshape(len(nodes), -1)
            one, two = np.flatnonzero(right), np.flatnonzero(~right)
            if not sampled and not len(one):  # a block with itself
                one = two
            left, other = [], []
            for at in range(0, len(one), TILE):
                own = one[at : at + TILE]
                linked = (x[own] @ x[two].T >= least) & (nodes[own][:, None] != nodes[two][None, :])
                if sampled:
                    i = np.flatnonzero(linked.any(axis=1))
                    j = linked[i].argmax(axis=1)
                else:
                    i, j = np.nonzero(linked)
                left.append(nodes[own[i]])
                other.append(nodes[two[j]])
            if left:
                a, c = np.concatenate(left), np.concatenate(other)
                a, c = (a, c) if sampled else _stars(a, c)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], schema=schema)

    return run


def _count_links(least: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by component and pair of blocks; one such pair at a time is held."""

        def pair(rows: pa.RecordBatch) -> pa.RecordBatch:
            right = rows.column(3).to_numpy(zero_copy_only=False)
            nodes, many = (rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            offsets, data = C.utf8_column(rows.column(6))
            x = data[offsets[0] : offsets[-1]].view(np.float64).reshape(len(nodes), -1)
            lone = not right.any()
            one, two = (np.flatnonzero(~right), np.flatnonzero(~right if lone else right))
            ahead, behind = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
            y = x[two].T
            for at in range(0, len(one), TILE):
                own = one[at : at + TILE]
                linked = x[own] @ y >= least
                if lone:
                    linked[np.arange(len(own)), np.arange(at, at + len(own))] = False
                ahead[at : at + TILE] = linked @ many[two]
                behind += many[own] @ linked
            if lone:
                return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ahead)], schema=schema)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[nodes[one], nodes[two]]), pa.array(np.r_[ahead, behind])], schema=schema)

        for rows in _block_rows(batches, 3):
            yield pair(rows)

    return run


def usable(vector: str) -> F.Column:
    """Not null, not zero, and all components are finite."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _with_units(rows: DataFrame, more: str) -> DataFrame:
    """rows with their last column, v, as unit in double precision, in bytes. more: the other columns and their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for at, x in _matrices(b.column(last)):
                kept = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(last)), _binary_rows(_unit(x))], names=[*b.schema.names[:last], "unit"])

    return rows.mapInArrow(run, f"{more}, unit binary")


def _passes(points: DataFrame, means: DataFrame, passes: int, window: int, least: float, seed: int) -> DataFrame:
    """(a, b): links that passes of sorted projections meet among points (label, width, node, v)."""
    spark = points.sparkSession
    centred = points.join(means.select("label", "width", "mean"), ["label", "width"]).select("label", "node", "v", "mean")
    spread = centred.mapInArrow(_project(passes, seed), "pass int, label long, width int, key long, node long, unit binary")
    ordered = spread.repartitionByRange(C.shuffle_partitions(spark), "pass", "label", "width", "key", "node").sortWithinPartitions("pass", "label", "width", "key", "node")
    met = C.materialize(ordered.select(F.lit(0).alias("edge"), "pass", "label", "width", "node", "unit").mapInArrow(_window_pairs(window, least, True), _FOUND), "met")
    edges = met.filter("edge is not null").select("edge", "pass", "label", "width", "side", F.col("b").alias("at"), F.col("a").alias("node"), "unit")
    behind = edges.repartition("edge").sortWithinPartitions("edge", "pass", "label", "width", "side", "at").select("edge", "pass", "label", "width", "node", "unit").mapInArrow(_window_pairs(window, least, False), _FOUND)
    return met.filter("edge is null").select("a", "b").unionByName(behind.select("a", "b"))


def _probed(points: DataFrame, means: DataFrame, least: float) -> DataFrame:
    """(label, width, a, b): a sample of the links of PROBES points of each label and width, each looked for in all of them."""
    rank = F.row_number().over(Window.partitionBy("label", "width").orderBy(F.xxhash64("node", F.lit(7))))  # limited by task before it is shuffled
    probes = points.select("label", "width", "node", "v").withColumn("_r", rank).filter(F.col("_r") <= PROBES).drop("_r")
    blocks = means.select("label", "width", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    every = points.join(blocks, ["label", "width"]).withColumn("lo", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")).select("label", "width", "lo", F.lit(0).alias("hi"), F.lit(False).alias("right"), "node", "v")
    asked = probes.join(blocks, ["label", "width"]).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "width", "lo", F.lit(0).alias("hi"), F.lit(True).alias("right"), "node", "v")
    keys = ["label", "width", "lo", "hi"]
    units = _with_units(every.unionByName(asked).repartition(*keys), "label long, width int, lo int, hi int, right boolean, node long")
    links = units.sortWithinPartitions(*keys, "right").mapInArrow(_block_links(least, True), "a long, b long")
    return links.join(points.select(F.col("node").alias("a"), "label", "width"), "a")


def _whole(points: DataFrame, means: DataFrame, least: float) -> DataFrame:
    """(a, b): all links of points, a pair of blocks of a label at a time, as stars."""
    sized = points.join(means.select("label", "width", F.least(F.ceil(F.col("n") / BLOCK), F.greatest(F.lit(MANY), F.ceil(F.col("n") / LARGEST))).cast("int").alias("blocks")), ["label", "width"])
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["label", "width", "lo", "hi"]
    dealt = dealt.select("label", "width", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"), "node", "v")
    return _with_units(dealt.repartition(*keys), "label long, width int, lo int, hi int, right boolean, node long").sortWithinPartitions(*keys, "right").mapInArrow(_block_links(least, False), "a long, b long")


def joined(points: DataFrame, least: float, seed: int = 11, rounds: tuple = ROUNDS, recall: float = RECALL) -> DataFrame:
    """(node, component) of points (node, label, width, v): nodes with links, after as many rounds as their labels need."""
    sums = points.select("label", "v").mapInArrow(_sums, "label long, width int, n long, total binary")
    means = C.materialize(sums.repartition("label", "width").sortWithinPartitions("label", "width").mapInArrow(_mean, "label long, width int, n long, mean binary"), "means")
    probed = C.materialize(_probed(points, means, least), "probed")
    found, todo = None, means
    for k, (passes, window) in enumerate([*rounds, (0, 0)]):
        own = points if found is None else points.join(todo.select("label", "width"), ["label", "width"], "left_semi")
        cheap = F.col("n") <= 2 * passes * window if k else F.lit(False)
        if not passes:
            links = _whole(own, todo, least)
        else:
            links = _passes(own if not k else own.join(todo.filter(~cheap).select("label", "width"), ["label", "width"], "left_semi"), todo.filter(~cheap), passes, window, least, seed + k)
            if k:
                links = links.unionByName(_whole(own.join(todo.filter(cheap).select("label", "width"), ["label", "width"], "left_semi"), todo.filter(cheap), least))
        before = found
        if before is not None:
            links = links.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = C.materialize(components(links.distinct()), "components")
        if before is not None:
            C.release(before)
        if not passes:
            break
        ends = probed.join(found.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
        share = ends.groupBy("label", "width").agg(F.avg(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).cast("double")).alias("recall"))
        low = share.filter(F.col("recall") < recall).select("label", "width")
        todo = C.materialize(todo.filter(~cheap).join(low, ["label", "width"], "left_semi"), "todo")
        if todo.isEmpty():
            break
    return found


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, seed: int = 11, block: int = BLOCK, rounds: tuple = ROUNDS, recall: float = RECALL) -> DataFrame:
    """Per row of vectors: id_col, n_links, component_id and kept (id_col = component_id).

    Two vectors are linked if their labels, of any kind, are equal and not null and their cosine in double precision is at
    least least. Vectors of different width, and ones that usable() refuses, link with nothing and are kept. Rows of a null
    id count as vectors; their component is the smallest id they reach, or null. Repeated rows link with each other. An
    empty table gives an empty one.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{label_col}`").alias("label"))
    if isinstance(rows.schema["label"].dataType, IntegralType):
        rows = rows.withColumn("label", F.col("label").cast("long"))
    else:
        names = C.materialize(rows.select("label").filter("label is not null").distinct().withColumn("_label", F.monotonically_increasing_id()), "labels")
        rows = rows.join(names, "label", "left").select("id", "v", F.col("_label").alias("label"))
    ok = usable("v") & F.col("label").isNotNull()
    named = rows.withColumn("node", F.when(ok, F.xxhash64("label", "v")))
    grouped = named.filter("node is not null").groupBy("node", "label", "v").agg(F.count("*").alias("many"), F.min("id").alias("least"))
    points = C.materialize(grouped.withColumn("width", F.size("v")), "points")
    found = joined(points.select("node", "label", "width", "v"), least, seed, rounds, recall)

    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    members = found.join(sizes, "component").join(points.select("node", "label", "many", "v"), "node")
    blocks = F.least(F.ceil(F.col("size") / F.lit(block)), F.greatest(F.lit(MANY), F.ceil(F.col("size") / F.lit(LARGEST)))).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"), "node", "many", "v")
    units = _with_units(dealt, "component long, lo int, hi int, right boolean, node long, many long")
    counted = units.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "right").mapInArrow(_count_links(least), "node long, links long")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    owned = points.select("node", "many", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    stats = owned.join(first, "component").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = named.select("id", "node").join(stats, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    return embedding_links(C.table(spark, sf_dir, "embeddings"))
