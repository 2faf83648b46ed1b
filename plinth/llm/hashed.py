"""Hashed features of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
_SPACED = bytes(b if b not in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b".,;:!?-"


def word_features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Ids of the distinct words of a text (lower case, punctuation as space) and of their beginnings of 4 and 6 bytes, which inflected words share."""
    words = set(text.lower().translate(_SPACED).split())
    ids = list(map(crc32, words))
    for k in (4, 6):
        ids += [crc32(x, k) for x in {w[:k] for w in words}]
    return (np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)).astype(np.int32)


def shape_features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Ids of a text's shape: its shares of capitals, symbols and marks, of words that are new, and of lines that are, by steps."""
    dense = len(text.translate(None, b" \t\n\v\f\r")) or 1
    words = text.split()
    lines = text.split(b"\n")
    n = len(words)
    shares = (
        (len(text) - len(text.translate(None, _UPPER))) / dense,
        (len(text) - len(text.translate(None, _SYMBOLS))) / dense,
        (len(text) - len(text.translate(None, _MARKS))) / dense,
        len(set(words)) / max(n, 1),
        len(set(lines)) / len(lines),
        min(n, 20) / 20,
    )
    steps = (int(20 * s) for s in shares)
    return np.array([_shape(i, k, bits) for i, k in enumerate(steps)], np.int32)


def _shape(i: int, step: int, bits: int) -> int:
    return crc32(b"\0%d:%d" % (i, step)) & ((1 << bits) - 1)


def shape_ids(bits: int = BITS) -> np.ndarray:
    return np.unique([_shape(i, k, bits) for i in range(6) for k in range(21)])


def all_features(text: bytes, bits: int = BITS) -> np.ndarray:
    return np.r_[word_features(text, bits), shape_features(text, bits)]


#: Feature ids that a sample has at most.
MOST_IDS = 24_000_000


def sampled_features(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", features=all_features, most_ids: int = MOST_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, features, row starts) of a sample of at most rows labelled rows, and of at most most_ids features: those of the smallest hashes of their ids.

    Only the sample's ids are broadcast, and only its features come to the driver; rows and most_ids bound both.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias(label)).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen.select(F.col(id_col), F.col(label).cast("string").alias("_label"))), id_col).select("_label", F.xxhash64(id_col).alias("_order"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches_of(batches, 16 << 20):
            offsets, data = C.utf8_column(b.column(2))
            view, at = memoryview(data), offsets.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(features(bytes(view[s:e]))) for s, e in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32()))], names=["_label", "_order", "ids"])

    # An id that several rows of docs share counts once.
    found = texts.mapInArrow(run, "_label string, _order long, ids array<int>").groupBy("_order").agg(F.min(F.struct(F.xxhash64("_label", "ids"), "_label", "ids")).alias("e"))
    found = C.materialize(found.select("_order", "e._label", "e.ids"), "features")
    sizes = found.select("_order", F.size("ids").alias("n")).orderBy("_order").toArrow()  # rows at most
    upto = np.cumsum(sizes["n"].to_numpy()) <= most_ids
    if not upto.any():
        return np.zeros(0, object), np.zeros(0, np.int64), np.zeros(1, np.int64)
    got = found.filter(F.col("_order") <= int(sizes["_order"].to_numpy()[upto][-1])).orderBy("_order").toArrow()
    C.release(found)
    ids = got.column("ids").combine_chunks()
    width = ids.value_lengths().to_numpy(zero_copy_only=False)
    return np.array(got.column("_label").to_pylist(), object), ids.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(width)]


def telling(ids: np.ndarray, classes: np.ndarray, share: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature: chi-squared of its classes against the sample's (0 for fewer than 5 rows), and how much more frequent each class is with it. classes: of the row that each id is of."""
    total = np.bincount(ids, minlength=1 << bits)
    found, lifts = np.zeros(1 << bits), np.zeros((len(share), 1 << bits))
    for k, p in enumerate(share):
        if p > 0:
            expected = np.maximum(total * p, 1e-9)
            seen = np.bincount(ids[classes == k], minlength=1 << bits)
            found += (seen - expected) ** 2 / expected
            lifts[k] = seen / expected
    return np.where(total >= 5, found, 0), lifts


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.r_[np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)]
    return total[starts[1:]] - total[starts[:-1]]
