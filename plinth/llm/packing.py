"""Best-fit packing of tokenised documents by minimum bin slack.

The lengths' histogram has as many rows as a sequence has places, whatever the corpus; all combinations are found on it.
For each: the longest length left is taken, and a subset-sum dynamic program over the lengths left, as a bitset, finds
the fullest combination with it. The combination is repeated as often as the histogram allows, so each one uses a length
up and the number of combinations is about that of the lengths. Pieces then find their place by their rank among those
of equal length, which is counted by buckets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
#: Buckets in which pieces of equal length are ranked, at least; there are as many as shuffle partitions if these are more.
BUCKETS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """(fast encoder or None, the library's tokenizer, contents of added tokens). The fast one is used where a merge's rank is its token's id, as ids are then the same."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [x["content"] for x in spec.get("added_tokens") or []]
    fast = None
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", [])]
    ids = [model["vocab"][m] for m in merged] if model.get("type") == "BPE" else []
    if ids and ids == sorted(ids) and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("ignore_merges"):
        import tiktoken
        from public_tokenizers import PATTERN

        to_byte = _byte_of_character()
        known = {t: i for t, i in model["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks={bytes(to_byte[c] for c in t): i for t, i in known.items()}, special_tokens={})
    return fast, exact, added


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a whole text, as tokenizers gives them with add_special_tokens=False."""
    fast, exact, added = _encoder(path)
    if fast is not None and not any(a in text for a in added):
        try:
            return np.asarray(fast.encode_to_numpy(text), np.uint32)
        except (ValueError, OverflowError):  # the fast one's pattern gives up on some very long runs
            pass
    return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Per piece: id_col, piece (from 0), start, length and ids (binary, little-endian unsigned 32-bit).

    A document is the ids of its whole text (null: empty) and end_id. Longer ones than capacity are cut from the end into
    pieces of capacity tokens, so that the first piece may be shorter. Repeated rows are cut each. Other columns are dropped.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches_of(batches, 8 << 20):
            rows, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                tokens = np.r_[token_ids(text or "", path), np.uint32(end_id)].astype("<u4")
                n = len(tokens)
                at, to = 0, n % capacity or min(n, capacity)
                k = 0
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    ids.append(tokens[at:to].tobytes())
                    at, to, k = to, to + capacity, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) whose lengths use the histogram up, none over capacity."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to capacity")
    found = []
    within = (1 << (capacity + 1)) - 1
    while left:
        longest = max(left)
        chosen = {longest: 1}
        room = capacity - longest
        if room:
            reach, steps = 1, []
            for n in sorted((x for x in left if x <= room), reverse=True):
                have = min(left[n] - (n == longest), room // n)
                part = 1
                while have > 0 and not reach >> room & 1:
                    part = min(part, have)
                    steps.append((n, part, reach))
                    reach |= (reach << (n * part)) & within
                    have -= part
                    part *= 2
                if reach >> room & 1:
                    break
            full = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
            for n, part, before in reversed(steps):
                if not before >> full & 1:
                    chosen[n] = chosen.get(n, 0) + part
                    full -= n * part
        times = min(left[n] // k for n, k in chosen.items())
        found.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return found


def _places(found: list[tuple[int, dict[int, int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Per length and combination, sorted: length * 2**44 + first rank, number in a sequence, first sequence, first offset."""
    rank = [0] * (capacity + 1)
    rows = []
    sequence = 0
    for times, chosen in found:
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n << 44 | rank[n], k, sequence, offset, rank[n]))
            rank[n] += times * k
            offset += n * k
        sequence += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length, from 1 to capacity) with sequence_id and offset (long).

    Pieces of a sequence lie one after another from 0. order: columns by which pieces of equal length are told apart; rows
    that agree in all of them may change places. pieces must give the same rows each time it is read. Columns of pieces
    that are named like an output are replaced. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    buckets = max(BUCKETS, C.shuffle_partitions(pieces.sparkSession))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = _places(combinations(histogram, capacity), capacity)
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)).cast("long")
    ranked = dealt.withColumn("_own", own).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    rest = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, first, offset, base = table
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, (length.astype(np.int64) << 44) | rank, side="right") - 1
            nth = rank - base[at]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(first[at] + nth // number[at]), pa.array(offset[at] + nth % number[at] * length)], names=[*rest, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in rest)
    return ranked.select(*rest, "_rank").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenized_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(C.materialize(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed_documents(C.table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places, as op2_best_fit_packing gives them."""
    return packed_documents(docs)
