"""SimHash near-dedup by segment popcounts.

A fingerprint's 32 segments of two bits are mapped to their bit counts. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints. The vectors' coordinates are cut into groups; within a distance of d at
least (groups - d) of them are equal, so each choice of that many groups is a grid whose cell a vector falls in, and
close vectors share a cell of one of these grids. Within a cell the Manhattan distance rules pairs out, and the rest is
verified exactly. More groups make cells finer; their number follows that of the points and doesn't change the result.

Copies share a fingerprint and are one point. A cell's links are returned as a forest, not as all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

ODD = 0x5555555555555555
#: Cells with more points are searched from point to point instead of pair by pair.
SMALL_CELL = 8
#: Points of a cell, on average, beyond which finer grids are taken.
CELL = 2


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=edges[1:])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(edges[: len(words) - k + 1].tolist(), (edges[k:] - 1).tolist(), strict=True)])
    n = len(hashes) // 8
    columns = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of 255 bits fit a byte
        ones += np.add.reduce(np.unpackbits(columns[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, text_col: str = "text", words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs without the text but with fp (long, the bits as they are)."""
    rest = [c for c in docs.columns if c not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = C.utf8_column(b.column(b.schema.get_field_index(text_col)))
            view = memoryview(data)
            at = offsets.tolist()
            out = b"".join([fingerprint(bytes(view[s:e]), words_per_shingle, seed) for s, e in zip(at[:-1], at[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(np.frombuffer(out, ">i8").astype(np.int64))], names=[*rest, "fp"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.select(*rest, text_col).mapInArrow(run, f"{fields}fp long")


def _unary(x: np.ndarray) -> np.ndarray:
    """Each two-bit segment as its bit count in unary, so that the distance of counts is that of bits."""
    half = x >> np.uint64(1)
    return ((x | half) & np.uint64(ODD)) | (((x & half) & np.uint64(ODD)) << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    near = np.bitwise_count(_unary(a) ^ _unary(b)) <= most
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count((a[at] if a.ndim else a) ^ b[at]) <= most
    return near


def _forest(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) of the linked sets of a large cell. Only points that aren't reached yet are compared."""
    left = np.unique(points)
    ends, roots = [], []
    while len(left):
        root, left = left[0], left[1:]
        reached = [np.array([root])]
        while reached and len(left):
            wave = reached.pop()
            for p in wave:
                near = _near(p, left, most)
                if near.any():
                    hit, left = left[near], left[~near]
                    ends.append(hit)
                    roots.append(np.full(len(hit), root))
                    reached.append(hit)
                    if not len(left):
                        break
    none = np.zeros(0, np.uint64)
    return (np.concatenate(ends), np.concatenate(roots)) if ends else (none, none)


def _cell_links(keys: np.ndarray, points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    starts, lengths = C.runs(keys)
    left, right = [], []
    many = lengths > 1
    starts, lengths = starts[many], lengths[many]
    small = lengths <= SMALL_CELL
    at = C.ranges(starts[small], lengths[small])
    end = np.repeat(starts[small] + lengths[small], lengths[small])
    for lag in range(1, SMALL_CELL):
        i = at[at + lag < end]
        a, b = points[i], points[i + lag]
        near = _near(a, b, most)
        left.append(a[near])
        right.append(b[near])
    for s, n in zip(starts[~small], lengths[~small], strict=True):
        a, b = _forest(points[s : s + n], most)
        left.append(a)
        right.append(b)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))


def _links(most: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _cell_links(rows[0], rows[1].view(np.uint64), most)
        pairs = np.unique(np.stack([a, b]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    return _buckets(of)


def groups_for(points: int, most_bits: int = 4) -> int:
    """The fewest groups for which a cell has about CELL points at most, as a segment's count has an entropy of 1.5 bits. The result is the same for any number."""
    for groups in range(2 * most_bits, 33, 2):
        if points <= CELL * 2 ** (1.5 * 32 * (groups - most_bits) / groups):
            return groups
    return 32


def fingerprint_links(points: DataFrame, most_bits: int = 4, groups: int = 8) -> DataFrame:
    """(a, b) with a > b: links whose linked sets are those of all pairs of points.fp that differ in most_bits bits or fewer. Points are distinct."""
    if not most_bits < groups <= 32:
        raise ValueError("groups must be over most_bits, and 32 at most")
    edge = [2 * round(32 * g / groups) for g in range(groups + 1)]
    masks = [sum(((1 << (edge[g + 1] - edge[g])) - 1) << edge[g] for g in chosen) for chosen in combinations(range(groups), groups - most_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fp = F.col("fp")
    half = F.shiftrightunsigned("fp", 1)
    unary = fp.bitwiseOR(half).bitwiseAND(F.lit(ODD)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(ODD)), 1))
    cells = points.select("fp", unary.alias("counts")).select("fp", "counts", F.posexplode(F.array(*map(F.lit, signed))).alias("grid", "mask"))
    cells = cells.select(F.xxhash64("grid", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(most_bits), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, seed: int = 42, most_bits: int = 4, groups: int | None = None) -> DataFrame:
    """Per row of docs: id_col, fp and component_id, the smallest id that links of most_bits or fewer reach, itself included.

    Null and wordless texts have fingerprint zero and link like any other. Rows with a null id get the smallest other id
    of their set (null if there is none). Repeated rows are one point. An empty table gives an empty one.
    """
    prints = C.materialize(fingerprints(docs.select(id_col, text_col), text_col, words_per_shingle, seed), "fingerprints")
    points = C.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "points")
    found = components(fingerprint_links(points, most_bits, groups or groups_for(points.count(), most_bits)))
    owned = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = owned.join(named, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    out = simhash_components(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts: sets of shingles that share one of their rarest members, found without loss.

#: Buckets with more texts are linked to a hub first; pairs are made only of texts that this leaves apart.
SMALL_BUCKET = 16
#: Shingles of COMMON texts or more in a sample (one text of SAMPLE), the LISTED most frequent ones, come last in the order of shingles. The order decides the work, not the result.
SAMPLE, COMMON, LISTED = 16, 3, 200_000
#: Bounds are lowered by so much, so that rounding loses no pair.
SLACK = 1e-6


def shingle_set(text: bytes, words_per_shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (fewer words: of all of them; none: none)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=edges[1:])
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(edges[: len(words) - k + 1].tolist(), (edges[k:] - 1).tolist(), strict=True)]), ">u8").astype(np.uint64))


def set_key(hashes: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of its members."""
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), 1), "big", signed=True)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    for b in C.batches_of(batches, 8 << 20):
        offsets, data = C.utf8_column(b.column(column))
        view, at = memoryview(data), offsets.tolist()
        yield b, (bytes(view[s:e]) for s, e in zip(at[:-1], at[1:], strict=True))


def _keys(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(shingle_set(t, k)) for t in texts], pa.int64())], names=["id", "key"])

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, k) for t in texts)]).view(np.int64))], names=["shingle"])

    return run


def _sets(k: int):
    """(key, shingles) of (key, text). A repeated id may bring another text than the key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches, 1):
            own = [(key, s.tobytes()) for key, t in zip(b.column(0).to_pylist(), texts, strict=True) if set_key(s := shingle_set(t, k)) == key]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.binary())], names=["key", "shingles"])

    return run


def _prefixes(k: int, least: float, common: np.ndarray, level: np.ndarray):
    """The first shingles of each set: two sets of a similarity of least or more have their first shared one among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches, 1):
            first, keys, sizes = [np.zeros(0, np.uint64)], [], []
            for key, t in zip(b.column(0).to_pylist(), texts, strict=True):
                s = shingle_set(t, k)
                if not len(s) or set_key(s) != key:
                    continue
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, level[at], 0), kind="stable")]
                keys.append(key)
                sizes.append(len(s))
                first.append(s[: len(s) - math.ceil(least * len(s) - SLACK) + 1])
            n = np.array([len(f) for f in first[1:]], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(first).view(np.int64)),
                    pa.array(np.repeat(np.array(keys, np.int64), n)),
                    pa.array(np.repeat(np.array(sizes, np.int32), n)),
                    pa.array(C.ranges(np.zeros(len(n), np.int64), n).astype(np.int32)),
                ],
                names=["shingle", "key", "size", "place"],
            )

    return run


def _buckets(of):
    """An Arrow step: of(rows) for rows sorted by their first column; a bucket that a batch may not hold whole waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, waiting = None, [], 0
        for b in batches:
            new.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
            waiting += b.num_rows
            if waiting < max(20_000, held.shape[1] if held is not None else 0):  # a large bucket is copied a few times only
                continue
            held = np.concatenate(([held] if held is not None else []) + new, axis=1)
            new, waiting = [], 0
            if whole := int(np.searchsorted(held[0], held[0, -1])):
                yield from of(held[:, :whole])
                held = held[:, whole:]
        if held is not None or new:
            yield from of(np.concatenate(([held] if held is not None else []) + new, axis=1))

    return run


def _may(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether sets can be similar whose first shared shingle is the bucket's: all that they share comes from there on."""
    x, y = size[i], size[j]
    rest = np.minimum(x - place[i], y - place[j])
    return (np.minimum(x, y) >= least * np.maximum(x, y) - SLACK) & (rest >= least / (1 + least) * (x + y) - SLACK)


def _meetings(least: float):
    """(shingle, a, b, size, place): pairs (size 0) of small buckets and of large ones with their hub; and the rows of large buckets."""
    names = ["shingle", "a", "b", "size", "place"]

    def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, key, size, place = rows
        starts, lengths = C.runs(shingle)
        small = lengths <= SMALL_BUCKET
        at = C.ranges(starts[small], lengths[small])
        end = np.repeat(starts[small] + lengths[small], lengths[small])
        pairs = [np.zeros((2, 0), np.int64)]
        for lag in range(1, SMALL_BUCKET):
            i = at[at + lag < end]
            i = i[_may(size, place, i, i + lag, least)]
            pairs.append(np.stack([key[i], key[i + lag]]))
        for s, n in zip(starts[~small], lengths[~small], strict=True):
            # The set in which fewest members are rarer than the shared one: of a family of copies, the one with the fewest edits.
            i = np.arange(s, s + n)
            hub = np.full(n, s + np.lexsort((key[i], size[i], place[i]))[0])
            ok = _may(size, place, i, hub, least)
            pairs.append(np.stack([key[i[ok]], key[hub[ok]]]))
        two = np.concatenate(pairs, axis=1)
        two = np.unique(np.sort(two[:, two[0] != two[1]], axis=0), axis=1)
        large = C.ranges(starts[~small], lengths[~small])
        none = np.zeros(two.shape[1], np.int64)
        out = np.concatenate([np.stack([none, two[1], two[0], none, none]), np.stack([shingle[large], key[large], key[large], size[large], place[large]])], axis=1)
        yield pa.RecordBatch.from_arrays([*map(pa.array, out[:3]), *(pa.array(c.astype(np.int32)) for c in out[3:])], names=names)

    return _buckets(of)


def _apart(least: float):
    """(a, b): all pairs of a bucket that can be similar and are of different components."""

    def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, key, size, place, component = rows
        found, held = [], 0
        for s, n in zip(*C.runs(shingle), strict=True):
            part = component[s : s + n]
            if (part == part[0]).all():
                continue
            # Sizes come sorted, so the sets that are not too long for one follow it.
            until = np.searchsorted(size[s : s + n], size[s : s + n] / least + SLACK, side="right") + s
            for i in range(s, s + n - 1):
                j = np.arange(i + 1, until[i - s])
                j = j[component[j] != component[i]]
                j = j[_may(size, place, np.full(len(j), i), j, least)]
                if len(j):
                    found.append(np.stack([np.maximum(key[j], key[i]), np.minimum(key[j], key[i])]))
                    held += len(j)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.concatenate(found, axis=1), axis=1))], names=["a", "b"])
                    found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.concatenate(found, axis=1), axis=1))], names=["a", "b"])

    return _buckets(of)


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                keep.append(both >= least * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return run


def common_shingles(texts: DataFrame, count: int, words_per_shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, levels): the most frequent shingles of a sample of texts, sorted, and the logarithms of their counts."""
    share = max(1, min(SAMPLE, count // 5000))
    some = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counts = some.mapInArrow(_shingles(words_per_shingle), "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "shingle").limit(LISTED).toArrow()
    hashes = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (1 + np.log2(np.maximum(top.column(1).to_numpy(), 1))).astype(np.uint8)[order]


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): links of ids whose linked sets are those of all pairs of texts with a similarity of shingle sets (shared over all) of least or more.

    Shingles have one order, common ones last. Sets that are similar have their first shared shingle among the first
    (1 - least) of each, so all that share one of these meet in its bucket; sizes and places there rule pairs out, and the
    rest is checked on the sets. Large buckets are linked to hubs first, and then only pairs of different components are
    checked. Equal sets are one point, to which each of their ids is linked; wordless texts are equal. Rows of a null id are left out.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = C.materialize(rows.mapInArrow(_keys(words_per_shingle), "id long, key long"), "keys")
    points = C.materialize(prints.groupBy("key").agg(F.min("id").alias("id")), "points")
    common, level = common_shingles(rows, points.count(), words_per_shingle)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        sets = rows.join(points.join(ends, "key"), "id").select("key", "text").mapInArrow(_sets(words_per_shingle), "key long, shingles binary")
        sets = C.materialize(sets.dropDuplicates(["key"]), "sets")
        met = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        out = C.materialize(met.mapInArrow(_similar(least), "a long, b long"), "similar")
        C.release(sets)
        return out

    first = rows.join(points, "id").select("key", "text").mapInArrow(_prefixes(words_per_shingle, least, common, level), "shingle long, key long, size int, place int")
    met = C.materialize(first.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_meetings(least), "shingle long, a long, b long, size int, place int"), "meetings")
    links = verified(C.materialize(met.filter("size = 0").select("a", "b").distinct(), "pairs"))
    large = met.filter("size > 0").select("shingle", F.col("a").alias("key"), "size", "place")
    if not large.isEmpty():
        found = components(links).withColumnRenamed("node", "key")
        apart = large.join(found, "key", "left").select("shingle", "key", "size", "place", F.coalesce("component", "key").alias("component"))
        pairs = apart.repartition("shingle").sortWithinPartitions("shingle", "size").mapInArrow(_apart(least), "a long, b long").distinct()
        links = links.unionByName(verified(C.materialize(pairs, "pairs")))
    a, b = (points.select(F.col("key").alias(e), F.col("id").alias(f"{e}_id")) for e in "ab")
    named = links.join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    equal = prints.withColumnRenamed("id", "a").join(points.withColumnRenamed("id", "b"), "key").filter("a > b").select("a", "b")
    return named.unionByName(equal)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(node, component): of ids that similar_links() links to another one, the smallest id that links reach."""
    return components(similar_links(docs, id_col, text_col, words_per_shingle, least))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set stays, that with the smallest doc_id, of any kind; rows equal in doc_id and text are one. Rows without a doc_id can't be named and stay.

    Sets are those of op4's links (four words, four bits) and of texts whose five-word shingles have a similarity of 0.8 or
    more. Rows that share a doc_id but not the text are documents of their own: they go by a hash of both.
    """
    node = F.xxhash64("doc_id", "text")
    named = docs.filter("doc_id is not null").select(node.alias("node"), F.col("doc_id").alias("own"), "text")
    texts = named.select(F.col("node").alias("doc_id"), "text")
    exact = simhash_components(texts).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    sets = components(exact.unionByName(similar_links(texts)))
    members = sets.join(named.select("node", "own").distinct(), "node")
    first = members.groupBy("component").agg(F.min(F.struct("own", "node")).alias("first")).select("component", F.col("first.node").alias("first"))
    gone = members.join(first, "component").filter("node <> first").select(F.col("node").alias("_node"))
    kept = docs.filter("doc_id is not null").withColumn("_node", node).join(gone, "_node", "left_anti").dropDuplicates(["_node"])
    return kept.select(docs.columns).unionByName(docs.filter("doc_id is null"))
