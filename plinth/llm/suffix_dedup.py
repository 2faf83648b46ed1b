"""Suffix-array dedup: removes every byte covered by a long string that starts anywhere else too.

Shards. A window is a string of min_len bytes. Among the hashes of the GRAM-byte strings in a window the smallest one (the
rightmost of equals) owns it, so equal windows have equal owners at equal places. Consecutive windows with one owner make a
segment; segments go to the shard of their owner. Owners that occur once can't hold repeats. Segments that are equal
(by the owner's 64-bit hash and one of all bytes, made of a sum modulo 2^64 and one modulo a prime) are sorted once, with their number; so a passage or document with any number of copies is one row.
Each shard's text is sorted by induced sorting (sais.py); windows whose permuted common prefix reaches min_len repeat.

An owner with more than HOT segments that differ (the edge of a very common passage) is dealt out again by window: its
windows go by their own hash, and those whose hash is alone are done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .sais import permuted_lcp, suffix_array

GRAM = 32
#: Bytes of text that are hashed at once and (SHARD) sorted at once.
PIECE = 1 << 19
SHARD = 600_000
#: Segments with one owner that still go to one task.
HOT = 8192

_BASE = 0x9E3779B97F4A7C15
#: The second hash's modulus and base: sums modulo a power of two have known collisions, those modulo a prime other ones.
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_103_515_245
_SEGMENTS = pa.schema([("_id", pa.int64()), ("_th", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("times", pa.int32()), ("owner", pa.int64()), ("seg", pa.int64())])
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = PIECE + 1
    if len(_tables.get("prime_up", ())) != n:
        inverse = pow(_BASE, -1, 1 << 64)
        _tables["up"], _tables["down"] = (np.r_[np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))] for b in (_BASE, inverse))
        _tables["byte"] = _mix(np.arange(1, 257, dtype=np.uint64))
        for name, base in (("prime_up", _PRIME_BASE), ("prime_down", pow(_PRIME_BASE, -1, _PRIME))):
            powers = np.ones(1, np.uint64)
            while len(powers) < n:
                powers = np.r_[powers, powers * np.uint64(pow(base, len(powers), _PRIME)) % np.uint64(_PRIME)]
            _tables[name] = powers[:n]
        _tables["prime_byte"] = _tables["byte"] % np.uint64(_PRIME)
    return _tables["up"], _tables["down"], _tables["byte"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _segments(data: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(start, windows, owner hash, segment hash) of the segments of a piece of text."""
    up, down, byte = _powers()
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[data] * down[:n], out=prefix[1:])
    gram = _mix((prefix[GRAM:] - prefix[:-GRAM]) * up[: n - GRAM + 1])
    places = np.arange(len(gram), dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)
    best = _sliding_min((gram & ~low) | (low - places), min_len - GRAM + 1)
    owner = (low - (best & low)).astype(np.int64)
    start, count = C.runs(owner)
    owner = owner[start]
    length = count + min_len - 1
    prime = np.uint64(_PRIME)
    second = np.zeros(n + 1, np.uint64)
    np.cumsum(_tables["prime_byte"][data] * _tables["prime_down"][:n] % prime, out=second[1:])
    second = (second[start + length] - second[start]) % prime * _tables["prime_up"][start] % prime
    place = ((owner - start) * 4096 + length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    seg = _mix((prefix[start + length] - prefix[start]) * up[start] + place + _mix(second))
    return start, count, gram[owner].view(np.int64), seg.view(np.int64)


def _find_segments(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets, data = C.utf8_column(b.column(2))
            n = len(ids)
            at = 0
            while at < n:
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
                lo, hi = int(offsets[at]), int(offsets[upto])
                step = PIECE - min_len + 1
                for piece in range(lo, max(hi - min_len + 1, lo), step):
                    text = data[piece : min(piece + PIECE, hi)]
                    if len(text) < min_len:
                        continue
                    start, count, owner, seg = _segments(text, min_len)
                    if upto - at > 1:  # windows across documents don't count
                        keep = []
                        first = start + piece
                        last = first + count - 1
                        doc = np.searchsorted(offsets[at : upto + 1], first, side="right") - 1 + at
                        whole = last + min_len <= offsets[doc + 1]
                        for i in np.flatnonzero(~whole):  # cut at the edge of the document
                            s, e = int(first[i]), int(last[i])
                            d = int(doc[i])
                            while s <= e:
                                fit = min(e, int(offsets[d + 1]) - min_len)
                                if fit >= s:
                                    keep.append((s, fit - s + 1, int(owner[i]), d, s - piece))
                                s = max(s, int(offsets[d + 1]))
                                d += 1
                        extra = _rehash(text, keep, min_len)
                        start, count, owner, seg, doc = (np.r_[a[whole], b] for a, b in zip((first, count, owner, seg, doc), extra, strict=True))
                    else:
                        start, doc = start + piece, np.full(len(start), at)
                    # Periodic text gives one segment again and again; these rows are one with their number.
                    new = np.r_[True, (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])][: len(start)]
                    at_row = np.flatnonzero(new)
                    times = np.diff(np.r_[at_row, len(start)])
                    start, doc, count, owner, seg = (x[at_row] for x in (start, doc, count, owner, seg))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(hashes[doc]), pa.array((start - offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(owner), pa.array(seg)], schema=_SEGMENTS)
                at = upto

    return run


def _rehash(text: np.ndarray, cut: list[tuple[int, ...]], min_len: int) -> tuple[np.ndarray, ...]:
    """Segments that end at a document's edge, hashed from their own text alone so that they don't depend on the neighbour."""
    start, count, owner, seg, doc = ([] for _ in range(5))
    for s, n, _, d, at in cut:
        for a, k, o, h in zip(*_segments(text[at : at + n + min_len - 1], min_len), strict=True):
            start.append(s + a)
            count.append(k)
            owner.append(o)
            seg.append(h)
            doc.append(d)
    return tuple(np.array(x, np.int64) for x in (start, count, owner, seg, doc))


def _cut_texts(min_len: int):
    """Texts of the segments that represent their equals."""
    schema = pa.schema([("owner", pa.int64()), ("seg", pa.int64()), ("many", pa.int64()), ("hot", pa.bool_()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches_of(batches, 8 << 20):
            column = b.column("reps")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            reps = column.flatten()
            start, n = (reps.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
            texts, at = [], 0
            for data, k in zip(b.column("_data"), lengths, strict=True):
                data = data.as_py() or b""
                texts += [data[s : s + m + min_len - 1] for s, m in zip(start[at : at + k].tolist(), n[at : at + k].tolist(), strict=True)]
                at += k
            yield pa.RecordBatch.from_arrays([*(reps.field(k) for k in ("owner", "seg", "many", "hot")), pa.array(texts, pa.binary())], schema=schema)

    return run


def _shard_runs(texts: list[bytes], many: np.ndarray, min_len: int) -> list[list[int]]:
    """For each text, the runs (first window, windows, ...) of its windows that repeat in this shard."""
    lengths = np.array([len(x) for x in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    t = joined.astype(np.uint16) + np.uint16(2)
    t[ends] = 1
    t = np.r_[t, np.zeros(1, np.uint16)]
    used = np.unique(t)
    narrow = np.zeros(int(used[-1]) + 1, np.uint16)
    narrow[used] = np.arange(len(used))
    t = narrow[t]
    sa = suffix_array(t, len(used))
    lcp = permuted_lcp(t, sa)[sa] >= min_len
    repeats = np.zeros(len(t), bool)
    repeats[sa] = lcp | np.r_[lcp[1:], False]
    out = []
    for i, end in enumerate(ends):
        windows = repeats[end - lengths[i] : end - min_len + 1] | (many[i] > 1)
        s, n = C.runs(windows)
        hit = windows[s]
        out.append(np.c_[s[hit], n[hit]].ravel().tolist())
    return out


def _sort_shards(min_len: int):
    schema = pa.schema([("owner", pa.int64()), ("seg", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        owner, seg, many, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(seg, pa.int64()), pa.array(_shard_runs(list(texts), np.array(many), min_len), pa.list_(pa.int32()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by owner; shards are cut between owners."""
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield shard(held)

    return run


def _explode_windows(min_len: int):
    """Segments of hot owners by window: a segment of one window for each, named by the window's own hash."""
    schema = pa.schema([("owner", pa.int64()), ("seg", pa.int64()), ("window", pa.int32()), ("hash", pa.int64()), ("text", pa.binary()), ("many", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, seg, many, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(text) - min_len + 1
                pieces = [text[i : i + min_len] for i in range(n)]
                hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in pieces]
                yield pa.RecordBatch.from_arrays([pa.array([owner] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(hashes, pa.int64()), pa.array(pieces, pa.binary()), pa.array([many] * n, pa.int64())], schema=schema)

    return run


def _hot_spans(hot: DataFrame, min_len: int) -> DataFrame:
    """Spans of the segments of hot owners. A window goes by its hash; texts with the same hash are sorted in one shard, once each."""
    windows = hot.mapInArrow(_explode_windows(min_len), "owner long, seg long, window int, hash long, text binary, many long")
    distinct = windows.groupBy("owner", "hash").agg(F.sum("many").alias("many"), F.min("text").alias("text"), F.max("text").alias("other"))
    # Two texts under one hash are kept apart by sorting both; equal ones are one row with their number.
    texts = distinct.filter("many > 1").select("owner", "hash", F.explode(F.array_distinct(F.array("text", "other"))).alias("text"), F.when(F.col("text") == F.col("other"), F.col("many")).otherwise(F.lit(1).cast("long")).alias("many"))
    sorted_in = texts.select(F.col("hash").alias("owner"), F.col("owner").alias("seg"), "many", "text").repartition("owner").sortWithinPartitions("owner")
    found = sorted_in.mapInArrow(_sort_shards(min_len), "owner long, seg long, spans array<int>").filter("size(spans) > 0").select(F.col("seg").alias("owner"), F.col("owner").alias("hash")).distinct()
    return windows.select("owner", "seg", "window", "hash").join(found, ["owner", "hash"]).groupBy("owner", "seg").agg(F.flatten(F.transform(F.collect_list("window"), lambda w: F.array(w, F.lit(1)))).alias("spans"))


def _repeated(keyed: DataFrame, min_len: int, hot: int) -> DataFrame:
    """(_id, _th, starts) of the documents in keyed (_id, _th, _data and others) that have repeats."""
    spark = keyed.sparkSession
    ready = keyed.filter(F.length("_data") >= min_len).select("_id", "_th", "_data")
    segments = C.materialize(ready.mapInArrow(_find_segments(min_len), "_id long, _th int, start int, n int, times int, owner long, seg long"), "segments")
    folded = segments.groupBy("owner", "seg").agg(F.sum("times").alias("many"), F.min(F.struct("_id", "_th", "start", "n")).alias("rep"))
    owners = folded.groupBy("owner").agg(F.sum("many").alias("total"), F.count("*").alias("differ")).filter("total > 1")
    reps = C.materialize(folded.join(owners, "owner").select("rep.*", "owner", "seg", "many", (F.col("differ") > hot).alias("hot")), "representatives")
    per_doc = reps.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "n", "owner", "seg", "many", "hot")).alias("reps"))
    # All columns of keyed go along, so that this exchange of the texts is the one that the last step uses too.
    cut = keyed.join(per_doc, ["_id", "_th"]).mapInArrow(_cut_texts(min_len), "owner long, seg long, many long, hot boolean, text binary")

    def sort(rows: DataFrame) -> DataFrame:
        return rows.select("owner", "seg", "many", "text").repartition("owner").sortWithinPartitions("owner").mapInArrow(_sort_shards(min_len), "owner long, seg long, spans array<int>").filter("size(spans) > 0")

    if reps.filter("hot").isEmpty():
        spans = sort(cut)
    else:
        spans = sort(cut.filter("not hot")).unionByName(_hot_spans(cut.filter("hot").select("owner", "seg", "many", "text"), min_len))
    # A repeated row gives its segment more than once.
    spans = spans.groupBy("owner", "seg").agg(F.first("spans").alias("spans"))
    moved = F.when(F.col("times") > 1, F.array(F.col("start"), F.col("n") * F.col("times"))).otherwise(F.transform("spans", lambda v, i: F.when(i % 2 == 0, v + F.col("start")).otherwise(v)))
    return segments.join(spans, ["owner", "seg"]).select("_id", "_th", moved.alias("spans")).groupBy("_id", "_th").agg(F.flatten(F.collect_list("spans")).alias("starts"))


def _removed(starts, min_len: int) -> list[tuple[int, int]]:
    """Maximal [start, end) from runs of windows."""
    if starts is None or not len(starts):
        return []
    pairs = np.asarray(starts).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begin, end = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + min_len - 1
    reach = np.maximum.accumulate(end)
    fresh = np.r_[True, begin[1:] > reach[:-1]]
    first = np.flatnonzero(fresh)
    return list(zip(begin[first].tolist(), reach[np.r_[first[1:] - 1, len(end) - 1]].tolist(), strict=True))


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character is cut."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, characters: bool = False, hot: int = HOT) -> DataFrame:
    """docs with removed (array of byte spans) and kept (binary: the other bytes, in order).

    Every byte that a min_len-byte string covers which also starts anywhere else, in this document or another, is removed;
    all strings are judged on the input. characters: spans are shrunk to whole characters, so that kept is UTF-8.
    Null texts are empty and stay (kept: empty). Repeated rows repeat each other. Ids may be null or of any type that hashes.
    Columns of docs keep their names; one named like an output of this operator (removed, kept) is replaced.
    """
    if min_len < 2 * GRAM or min_len > 4096:
        raise ValueError(f"min_len must be from {2 * GRAM} to 4096")
    rest = [c for c in docs.columns if c not in ("removed", "kept", text_col)]
    # The text goes as bytes alone, the other columns as one, so that their names can't clash.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_any")).alias("_row"), *C.doc_key(docs, id_col, text_col), F.col(text_col).cast("binary").alias("_data"))
    joined = keyed.join(_repeated(keyed, min_len, hot), ["_id", "_th"], "left").select("_row", "_data", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches_of(batches, 8 << 20):
            removed, kept = [], []
            for data, starts in zip(b.column("_data"), b.column("starts").to_pylist(), strict=True):
                data = data.as_py() or b""
                spans = _removed(starts, min_len)
                spans = _whole_characters(data, spans) if characters else spans
                at, parts = 0, []
                for s, e in spans:
                    parts.append(data[at:s])
                    at = e
                removed.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b"".join(parts) + data[at:])
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_data"), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["_row", "_data", "removed", "kept"])

    schema = T.StructType([joined.schema["_row"], joined.schema["_data"]]).add("removed", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    out = joined.mapInArrow(run, schema)
    own = (F.col("_data").cast(docs.schema[text_col].dataType).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("removed", "kept"))
    return out.select(*own, "removed", "kept")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_array_dedup(docs)
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text lacks the passages that repeat; characters stay whole. The columns are those of docs; n_chars follows."""
    out = suffix_array_dedup(docs, characters=True).withColumn("text", F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
