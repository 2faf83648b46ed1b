"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

A word is reached in three choices of WAYS: its class (a bin of its count; words that training lacks are one class, the end
of a text another), then two steps inside the class: its topic, which is the bucket of the most frequent word of the texts
in which it is found most, and a hash of the word, or for rare words of its last letters. Each choice is a softmax over
hashed features of the history: the last word, the last two (n-grams), the one before the last alone (a skip), the last two
words' classes or topics; those inside the class are hashed together with the way so far.
What shares all three choices is told apart by counts, which are exact, by 64-bit hashes, and grow with the corpus:

    P(word | history) = P(class | history) P(step | class, history) P(step | steps, history) count(word) / count(cell).

When training, a token's class is that of its word's count without the token itself, so that new words are met as they will be.

Texts are coded once, in blocks of some MB, each with its own dictionary. To count words over the corpus, a block's
dictionary goes by buckets of the words' hashes as arrays, one row a block and bucket; a bucket's arrays meet in one task,
which sends totals back to the blocks. The number of buckets grows with the dictionaries, so that a bucket stays small; a
word that is in all blocks takes 13 bytes of each. Gradient steps run over the blocks of all training texts on the
executors; what leaves a task is one table of sums of features (3 MB at most), summed on executors before it comes to the
driver. Scoring is look-ups on arrays.

The first step's expected counts follow from the features' counts; the next ones take a batch of the blocks each, so that
training reads each text twice: once to count, once in a gradient step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from . import common as C

#: Text of a block, in bytes, about.
BLOCK = 5 << 20
#: Buckets of a dictionary's hashes are 2 ** BUCKET_BITS, and each is split on so that its arrays take about BUCKET_BYTES.
BUCKET_BITS, BUCKET_BYTES = 8, 32 << 20
WAYS = 16
NEW, END = WAYS - 2, WAYS - 1
BINS = WAYS - 2
#: Words of fewer occurrences are told apart by how they end.
FREQUENT = 256
#: Rows of the weights for each kind of feature, by choice.
KINDS = (("last", 0, 13), ("last two", 0, 15), ("classes", 0, 8), ("last", 1, 14), ("skip", 1, 13), ("topics", 1, 12), ("last", 2, 14))
ROWS = sum(1 << bits for _, _, bits in KINDS)
#: Shares of a step that are taken: of the first, from counts, and of one for each batch of blocks.
RATES = (0.6, 0.5, 0.4, 0.3)
#: Pseudo-counts of a step, and the largest weight, by which sums of a few stay in single precision's range.
SMOOTH, LARGEST = 2.0, 14.0
#: Tokens that are worked on at once, rows of a piece of the weights that travels, blocks of a task (fewer where that leaves cores idle).
SLICE, PIECE, TASK_BLOCKS = 1 << 14, 1024, 16


def _planes(codes: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones: words that come early, and so the frequent ones, leave the later planes zero."""
    return codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def spelling(word: bytes) -> int:
    return crc32(word[-2:]) % WAYS


def _coded_schema(id_type: T.DataType) -> T.StructType:
    schema = T.StructType().add("block", "long").add("ids", T.ArrayType(id_type)).add("held", T.ArrayType(T.BooleanType())).add("lengths", T.ArrayType(T.IntegerType()))
    for c in ("codes", "order", "marks"):
        schema = schema.add(c, "binary")
    return schema.add("bucket", "integer").add("hashes", "binary").add("n", "binary").add("steps", "binary")


def _code_blocks(modulus: int, rest: int, size_of_block: int):
    """Rows of texts (block, ids, held, lengths, codes; by code: marks of 16 bits; codes by hash: order) and of dictionaries (block, bucket, and by hash: hashes, n, steps: topic here * WAYS + ending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {}
        ids, held, lengths, codes, size = [], [], [], [], 0
        types: dict[str, pa.DataType] = {}

        def rows(many: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in types.items()], names=list(types))

        def block() -> Iterator[pa.RecordBatch]:
            many = len(known)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            named = np.frombuffer(b"".join(map(xxh64_digest, known)), ">u8").astype(np.uint64)
            # Votes of training texts for their words' topics: the bucket of a text's most frequent word.
            votes = np.zeros((many, WAYS), np.int64)
            for own, out in zip(codes, held, strict=True):
                if len(own) and not out:
                    seen, times = np.unique(own, return_counts=True)
                    most = seen[times == times.max()]
                    votes[seen, int(named[most].min()) % WAYS] += times
            order = np.argsort(named)
            n = votes.sum(axis=1)[order].astype("<i4")
            steps = (votes.argmax(axis=1) * WAYS + np.fromiter(map(spelling, known), np.int64, many))[order].astype(np.uint8)
            hashes = named[order]
            yield rows(1, block=[number], ids=[ids], held=[held], lengths=[lengths], codes=[_planes(flat)], order=[_planes(order.astype(np.int32))], marks=[(named & np.uint64(0xFFFF)).astype("<u2").tobytes()])
            bucket, at, wide = _slices(hashes, BUCKET_BITS)
            parts = list(zip(at.tolist(), (at + wide).tolist(), strict=True))
            if parts:
                yield rows(len(parts), block=np.full(len(parts), number), bucket=bucket, hashes=[hashes[s:e].tobytes() for s, e in parts], n=[n[s:e].tobytes() for s, e in parts], steps=[steps[s:e].tobytes() for s, e in parts])

        for b in C.batches_of(batches, size_of_block):
            types = types or {"block": pa.int64(), "ids": pa.list_(b.column(0).type), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "codes": pa.binary(), "order": pa.binary(), "marks": pa.binary(), "bucket": pa.int32(), "hashes": pa.binary(), "n": pa.binary(), "steps": pa.binary()}
            offsets, data = C.utf8_column(b.column(1))
            view, at = memoryview(data), offsets.tolist()
            for doc, s, e in zip(b.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                add = known.setdefault
                ids.append(doc)
                held.append(doc is not None and crc32(str(doc).encode()) % modulus == rest)
                codes.append(np.array([add(w, len(known)) for w in bytes(view[s:e]).lower().split()], np.int32))
                lengths.append(len(codes[-1]))
                size += e - s
                if size >= size_of_block:
                    yield from block()
                    number += 1
                    known = {}
                    ids, held, lengths, codes, size = [], [], [], [], 0
        if ids:
            yield from block()

    return run


def _slices(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, start, length) of the runs of sorted hashes with the same highest bits."""
    high = (hashes >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)
    at, wide = C.runs(high)
    return high[at], at, wide


def _split_buckets(bits: int):
    """Dictionary rows by the highest bits of their hashes, more than they come with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for block, _, hashes, n, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for bucket, s, k in zip(*_slices(np.frombuffer(hashes, np.uint64), bits), strict=True):
                    for o, v in zip(out, (block, bucket, hashes[8 * s : 8 * (s + k)], n[4 * s : 4 * (s + k)], steps[s : s + k]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, c.type) for o, c in zip(out, b.columns, strict=True)], schema=b.schema)

    return run


TOTALS = "block long, bucket int, counts binary, steps binary, kind int, key int, tokens long, words long"


def _total_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to rows of totals (block, bucket, counts, steps), and at the end those of the words by key, floor(log2(count)) * WAYS ** 2 + steps: kind 0 by count, kind 1 by count less one."""
    names = ("block", "bucket", "counts", "steps", "kind", "key", "tokens", "words")
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    shape = np.zeros((2, 2, 64 * WAYS**2), np.int64)
    held: list[tuple] = []

    def rows(many: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in zip(names, types, strict=True)], names=list(names))

    def flush() -> pa.RecordBatch:
        blocks, buckets, hashes, n, steps = zip(*held, strict=True)
        edges = np.cumsum([0, *(len(x) // 8 for x in hashes)])
        whole = np.frombuffer(b"".join(hashes), np.uint64)
        counts, steps = np.frombuffer(b"".join(n), "<i4").astype(np.int64), np.frombuffer(b"".join(steps), np.uint8).astype(np.int64)
        order = np.argsort(whole, kind="stable")
        at, wide = C.runs(whole[order])
        total = np.add.reduceat(counts[order], at)
        topic = np.maximum.reduceat((counts * WAYS + steps // WAYS)[order], at) % WAYS
        ending, mark = steps[order][at] % WAYS, (whole[order][at] % np.uint64(WAYS)).astype(np.int64)
        for kind in range(2):
            c = total - kind
            kept = c > 0
            key = (np.frexp(np.maximum(c, 1).astype(np.float64))[1] - 1) * WAYS**2 + topic * WAYS + np.where(c < FREQUENT, ending, mark)
            shape[kind, 0] += np.bincount(key[kept], total[kept], minlength=64 * WAYS**2).astype(np.int64)
            shape[kind, 1] += np.bincount(key[kept], minlength=64 * WAYS**2)
        back = np.empty(len(whole), np.int64)
        back[order] = np.repeat(total, wide)
        where = np.empty(len(whole), np.uint8)
        where[order] = np.repeat(topic * WAYS + ending, wide)
        parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return rows(len(parts), block=blocks, bucket=buckets, counts=[back[s:e].astype("<i8").tobytes() for s, e in parts], steps=[where[s:e].tobytes() for s, e in parts])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[1] != held[-1][1]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()
    kind, key = np.nonzero(shape[:, 1])
    yield rows(len(key), kind=kind.astype(np.int32), key=key.astype(np.int32), tokens=shape[kind, 0, key], words=shape[kind, 1, key])


@dataclass
class Vocabulary:
    tokens: int  # N
    distinct: int  # V
    ends: int
    bin_of_log: list[int]  # bin of floor(log2(count))
    mass: np.ndarray  # tokens by cell
    first: np.ndarray  # logarithms of the shares of classes, of steps by class, and of steps by class and step
    second: np.ndarray
    third: np.ndarray

    def ways(self, count: np.ndarray, steps: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Cell of each word: class * WAYS ** 2 + its two steps."""
        logs = np.frexp(np.maximum(count, 1).astype(np.float64))[1] - 1
        bins = np.array(self.bin_of_log)[np.minimum(logs, len(self.bin_of_log) - 1)]
        steps = np.where(count < FREQUENT, steps, steps // WAYS * WAYS + marks % WAYS)
        return np.where(count > 0, bins * WAYS**2 + steps, NEW * WAYS**2)


def _bins(by_log: dict[int, int]) -> list[int]:
    """Words of count one have a bin of their own; the others' bins have about as many tokens each."""
    top = max(by_log, default=0)
    total = sum(n for k, n in by_log.items() if k > 0) or 1
    out, seen = [0], 0
    for k in range(1, top + 1):
        seen += by_log.get(k, 0) / 2
        out.append(1 + min(int((BINS - 1) * seen / total), BINS - 2))
        seen += by_log.get(k, 0) / 2
    return out


def _shares(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of the shares of each choice, from tokens by cell. A choice that has none is all but ruled out."""

    def logs(n: np.ndarray) -> np.ndarray:
        whole = n.sum(axis=-1, keepdims=True)
        share = np.where(whole > 0, n / np.maximum(whole, 1), np.eye(1, n.shape[-1])[0])
        return np.maximum(np.log(np.maximum(share, 1e-300)), -30.0).astype(np.float32)

    cube = cells.reshape(WAYS, WAYS, WAYS).astype(float)
    return logs(cube.sum(axis=(1, 2))), logs(cube.sum(axis=2)), logs(cube).reshape(WAYS**2, WAYS)


def history_features(marks: np.ndarray, before: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """Row of each token's features, by kind, within the kind. marks, before: of the last word and the one before it (0: none); cells: of the token and, by them, of the last two."""
    last, skip, own = (x.astype(np.uint64) for x in (marks, before, cells))
    classes, topics = cells // WAYS**2, cells // WAYS % WAYS
    out = []
    for number, (kind, choice, bits) in enumerate(KINDS):
        if kind == "classes":
            one = np.r_[END, classes[:-1]]
            two = np.r_[END, one[:-1]]
            two[one == END] = END
            out.append((one * WAYS + two).astype(np.uint16))
            continue
        if kind == "topics":
            one = np.r_[0, topics[:-1]]
            out.append(((classes * WAYS + one) * WAYS + np.r_[0, one[:-1]]).astype(np.uint16))
            continue
        key = {"last": last, "skip": skip + np.uint64(1 << 20), "last two": last + (skip << np.uint64(24)) + np.uint64(1 << 50)}[kind]
        if choice:
            key = key + ((own >> np.uint64(8 if choice == 1 else 4)) << np.uint64(28))
        key = (key + np.uint64(number << 56)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.uint16))
    return out


_BASES = np.r_[0, np.cumsum([1 << bits for _, _, bits in KINDS])]


def _choices(vocabulary: Vocabulary, weights: np.ndarray, features: list[np.ndarray], cells: np.ndarray, part: slice) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(choice, probabilities, taken way) of a part of the tokens."""
    own = cells[part]
    ways = (own // WAYS**2, own // WAYS % WAYS, own % WAYS)
    starts = (vocabulary.first[None, :], vocabulary.second[ways[0]], vocabulary.third[own // WAYS])
    ones = np.ones(WAYS, np.float32)
    for choice in range(3):
        x = np.repeat(starts[0], len(own), axis=0) if not choice else starts[choice]
        for f, (_, at, _) in enumerate(KINDS):
            if at == choice:
                x += np.take(weights, _BASES[f] + features[f][part], axis=0)
        np.exp(x, out=x)  # LARGEST keeps it in range
        x /= (x @ ones)[:, None]
        yield choice, x, ways[choice]


def _token_arrays(lengths: np.ndarray, codes: np.ndarray, cells: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each token with the texts' ends, mark of the last word, of the one before, places of words, start of each text)."""
    ends = np.cumsum(lengths + 1) - 1
    n = int((lengths + 1).sum())
    words = np.ones(n, bool)
    words[ends] = False
    own, mark = np.full(n, END * WAYS**2, np.int32), np.zeros(n, np.int32)
    own[words] = cells[codes]
    mark[words] = marks[codes].astype(np.int32) + 1
    last = np.r_[0, mark[:-1]]
    before = np.r_[0, last[:-1]]
    before[last == 0] = 0
    return own, last, before, words, ends - lengths


def _block_columns(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """(held, lengths, codes, and by code: count, steps, marks)."""

    def column(name: str) -> pa.Array:
        return b.column(b.schema.get_field_index(name))

    held = column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
    lengths = column("lengths")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
    codes, order = (_from_planes(np.frombuffer(column(c)[i].as_buffer(), np.uint8)) for c in ("codes", "order"))
    count, steps = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    words = column("words")[i]
    if words.is_valid:
        parts = sorted(words.as_py(), key=lambda p: p["bucket"])
        count[order] = np.frombuffer(b"".join(p["counts"] for p in parts), "<i8")
        steps[order] = np.frombuffer(b"".join(p["steps"] for p in parts), np.uint8)
    return held, lengths, codes, count, steps, np.frombuffer(column("marks")[i].as_buffer(), "<u2").astype(np.int64)


def add_seen(own: np.ndarray, last: np.ndarray, before: np.ndarray, sums: np.ndarray) -> None:
    """Adds the ways taken with each feature."""
    ways = (own // WAYS**2, own // WAYS % WAYS, own % WAYS)
    for f, (feature, (_, choice, bits)) in enumerate(zip(history_features(last, before, own), KINDS, strict=True)):
        sums[_BASES[f] : _BASES[f + 1]] += np.bincount(feature.astype(np.int64) * WAYS + ways[choice], minlength=WAYS << bits).reshape(-1, WAYS)


def add_slope(vocabulary: Vocabulary, weights: np.ndarray, own: np.ndarray, last: np.ndarray, before: np.ndarray, sums: np.ndarray) -> float:
    """Adds the slope of the log likelihood by each weight, ways taken less expected; the log likelihood of the choices."""
    features = history_features(last, before, own)
    gain = 0.0
    for at in range(0, len(own), SLICE):
        part = slice(at, at + SLICE)
        for choice, p, way in _choices(vocabulary, weights, features, own, part):
            taken = np.arange(len(way)), way
            gain += float(np.log(np.maximum(p[taken], 1e-30)).sum(dtype=np.float64))
            p[taken] -= 1
            for f, (_, own_choice, _) in enumerate(KINDS):
                if own_choice == choice:
                    order = np.argsort(features[f][part], kind="stable")  # 16 bits: by radix
                    row = features[f][part][order]
                    starts = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1]
                    sums[_BASES[f] + row[starts]] -= np.add.reduceat(np.take(p, order, axis=0), starts, axis=0)
    return gain


def _short(values: np.ndarray) -> bytes:
    """The upper halves of single-precision numbers, rounded."""
    return ((values.astype(np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2").tobytes()


def _from_short(data) -> np.ndarray:
    return (np.frombuffer(data, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)


def _sums(vocabulary: Vocabulary, weights: np.ndarray | None):
    """(piece, values): sums over the training texts of a task's blocks, by pieces of the table: of ways seen, or with weights of the slope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((ROWS, WAYS), np.float32)
        for b in batches:
            for i in range(b.num_rows):
                held, lengths, codes, count, steps, marks = _block_columns(b, i)
                if held.all():
                    continue
                kept = codes[np.repeat(~held, lengths)]
                own, last, before, _, _ = _token_arrays(lengths[~held], kept, vocabulary.ways(count - 1, steps, marks), marks)
                if weights is None:
                    add_seen(own, last, before, sums)
                else:
                    add_slope(vocabulary, weights, own, last, before, sums)
        for piece, at in enumerate(range(0, ROWS, PIECE)):
            values = sums[at : at + PIECE]
            if values.any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([_short(values)], pa.binary())], names=["piece", "v"])

    return run


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            values = _from_short(v.as_buffer())
            held[piece] = held[piece] + values if piece in held else values.astype(np.float64)
    for piece, values in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([_short(values)], pa.binary())], names=["piece", "v"])


def task_number(spark: SparkSession, many: int) -> int:
    return max(1, min(many, max(spark.sparkContext.defaultParallelism, many // TASK_BLOCKS)))


def train(blocks: DataFrame, many: int, vocabulary: Vocabulary, rates: tuple[float, ...] = RATES) -> np.ndarray:
    """Weights by feature and way. Steps are those of iterative scaling, the logarithm of ways seen over ways expected: the first over all texts, each other one over a batch of the blocks, which together are all."""
    spark = blocks.sparkSession
    weights = np.zeros((ROWS, WAYS), np.float32)
    salts = max(1, task_number(spark, many) // 256)

    def summed(rows: DataFrame, by: np.ndarray | None) -> np.ndarray:
        parts = rows.mapInArrow(_sums(vocabulary, by), "piece int, v binary")
        if salts > 1:
            parts = parts.repartition(F.col("piece"), F.pmod(F.xxhash64("v"), F.lit(salts))).mapInArrow(_add_pieces, "piece int, v binary")
        got = parts.repartition("piece").mapInArrow(_add_pieces, "piece int, v binary").toArrow()  # one table of weights
        whole = np.zeros((ROWS, WAYS))
        for piece, v in zip(got["piece"].to_pylist(), got["v"].to_pylist(), strict=True):
            values = _from_short(v).reshape(-1, WAYS)
            whole[piece * PIECE : piece * PIECE + len(values)] = values
        return whole

    seen = summed(blocks, None)
    # Without weights a choice's ways go by their shares alone, and so a feature's expected ways by its count.
    expected = np.zeros_like(seen)
    for f, (_, choice, _) in enumerate(KINDS):
        part = slice(_BASES[f], _BASES[f + 1])
        share = np.exp(vocabulary.first) if not choice else seen[part].sum(axis=0) / max(seen[part].sum(), 1.0)
        expected[part] = seen[part].sum(axis=1, keepdims=True) * share
    weights = np.clip(rates[0] * np.log((seen + SMOOTH) / (expected + SMOOTH)), -LARGEST, LARGEST).astype(np.float32)
    batches = len(rates) - 1
    for number, rate in enumerate(rates[1:]):
        slope = summed(blocks.filter(F.pmod(F.xxhash64("block"), F.lit(batches)) == number), weights)
        own = seen / batches
        move = np.log((own + SMOOTH) / (np.maximum(own - slope, 0) + SMOOTH))
        weights = np.clip(weights + rate * move, -LARGEST, LARGEST).astype(np.float32)
    return weights


def _score(vocabulary: Vocabulary, weights: np.ndarray):
    log10 = 1 / math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = vocabulary.tokens + vocabulary.distinct + 1
        for b in batches:
            for i in range(b.num_rows):
                held, lengths, codes, count, steps, marks = _block_columns(b, i)
                cells = vocabulary.ways(count, steps, marks)
                own, last, before, words, starts = _token_arrays(lengths, codes, cells, marks)
                features = history_features(last, before, own)
                logs = np.zeros(len(own))
                for at in range(0, len(own), SLICE):
                    part = slice(at, at + SLICE)
                    for _, p, way in _choices(vocabulary, weights, features, own, part):
                        logs[part] += np.log(np.maximum(p[np.arange(len(way)), way], 1e-30))
                logs[words] += np.where(count > 0, np.log(np.maximum(count, 1) / np.maximum(vocabulary.mass[cells], 1)), 0.0)[codes]
                base = np.full(len(own), math.log10((vocabulary.ends + 1) / total))
                base[words] = np.log10((count + 1) / total)[codes]
                known = np.full(len(own), int(vocabulary.ends > 0))
                known[words] = (count > 0)[codes]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("ids"))[i].values, pa.array(held), pa.array(lengths + 1), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts) * log10)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, rest: int = 2, rates: tuple[float, ...] = RATES) -> DataFrame:
    """Per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32 of the id as text has remainder rest are held out; those of a null id aren't. Null texts are empty: one
    token, the end. Repeated rows count each. Without training texts all tokens are new; an empty table gives an empty one.
    Ids may be of any type; other columns of docs, of any name, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = _coded_schema(rows.schema["id"].dataType)
    # Texts and dictionaries go to folders of their own, so that the dictionaries can go first.
    path = C.scratch_path(spark, "coded")
    coded = rows.mapInArrow(_code_blocks(modulus, rest, BLOCK), schema).withColumn("part", F.when(F.col("bucket").isNull(), "texts").otherwise("words"))
    coded.write.partitionBy("part").option("compression", "zstd").parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    texts = coded.filter("part = 'texts'").select("block", "ids", "held", "lengths", "codes", "order", "marks")
    words = coded.filter("part = 'words'").select("block", "bucket", "hashes", "n", "steps")
    entries = words.agg(F.sum(F.octet_length("steps"))).first()[0] or 0
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(13 * entries / BUCKET_BYTES, 1))))
    if bits > BUCKET_BITS:
        words = words.mapInArrow(_split_buckets(bits), words.schema)
    dealt = words.repartition(max(C.shuffle_partitions(spark), 1 << (bits - 3)), "bucket").sortWithinPartitions("bucket")
    totals = C.materialize(dealt.mapInArrow(_total_buckets, TOTALS), "totals")
    C.drop_path(spark, f"{path}/part=words")
    per_block = totals.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "steps")).alias("words"))
    many = texts.count()
    blocks = C.materialize(texts.repartition(task_number(spark, many), "block").join(per_block, "block", "left"), "blocks")
    sizes = blocks.select(F.explode("held").alias("held")).groupBy("held").count().collect()
    ends = sum(r["count"] for r in sizes if not r["held"])
    C.drop_path(spark, path)
    shape = totals.filter("kind is not null").groupBy("kind", "key").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()  # 2 * 64 * WAYS ** 2 rows at most
    C.release(totals)
    whole = [r for r in shape if not r["kind"]]
    by_log: dict[int, int] = {}
    for r in whole:
        log = r["key"] // WAYS**2
        by_log[log] = by_log.get(log, 0) + r["tokens"]
    bins = _bins(by_log)

    def cells(kind: int) -> np.ndarray:
        out = np.zeros(WAYS**3)
        for r in shape:
            if r["kind"] == kind:
                out[bins[min(r["key"] // WAYS**2, len(bins) - 1)] * WAYS**2 + r["key"] % WAYS**2] += r["tokens"]
        return out

    mass, left = cells(0), cells(1)
    # Words of one occurrence are new without it.
    trained = left + 0.1 * (mass > 0)
    trained[NEW * WAYS**2], trained[END * WAYS**2] = mass.sum() - left.sum() + 1, ends + 1
    vocabulary = Vocabulary(sum(r["tokens"] for r in whole) + ends, sum(r["words"] for r in whole) + (ends > 0), ends, bins, mass, *_shares(trained))
    weights = train(blocks, many, vocabulary, rates) if ends else np.zeros((ROWS, WAYS), np.float32)
    fields = T.StructType().add("id", rows.schema["id"].dataType).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    out = blocks.mapInArrow(_score(vocabulary, weights), fields)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_texts(C.table(spark, sf_dir, "documents"))
