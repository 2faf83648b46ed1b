"""Token ids as ORC files in the order of the documents' ids.

A file holds a range of documents in order: id, start within the file, n_tokens and the ids as integers, which ORC
run-length encodes. Stripes have statistics of the ids, row indexes each ROW_INDEX rows and Bloom filters on the document's
id, so that readers split files by stripes, and a search for documents skips stripes and row groups by metadata alone.
Beside the files lies an index with a row for each: its first and last document, and the tokens of all files before it.

A tokenizer of words (normalised without context, never across white space) runs once on each distinct word of a worker's
texts; ids are those that the library gives for whole texts.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

END_ID = 2
STRIPE_BYTES, ROW_INDEX, BLOOM_FPP = 16 << 20, 1000, 0.01
#: Words whose ids a worker remembers; when there are more it begins anew.
MOST_WORDS = 1 << 19
#: Fixed values of the tokenizer files whose words can be taken apart: the normalisers, and the pattern that finds words.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

OTHER, SPACE, SIGN, SMALL, CAPITAL = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(9, 14), 32]] = SPACE
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = SIGN
_KIND[97:123], _KIND[65:91] = SMALL, CAPITAL


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, as tokenizers gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self.by_words = self._splits(spec)
        self.known: dict[bytes, bytes] = {}

    def _splits(self, spec: dict) -> bool:
        """Whether a text's ids are those of its words, one after another, and capitals are as good as small letters."""
        normal = (spec.get("normalizer") or {}).get("normalizers") or []
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        model = spec["model"]
        plain = [n["type"] for n in normal] == NORMALIZERS and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        words = [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": WORD_PATTERN} and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        bare = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not x["normalized"] for x in spec.get("added_tokens") or [])
        return bool(plain and words and bare and model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not spec.get("truncation") and not spec.get("padding"))

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.exact.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. A word of ASCII letters passes the normaliser and the pattern whole, so the model gets it at once."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        found = list(map(self.known.get, words))
        fresh = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not fresh:
            return found
        tokens = self.exact.model.tokenize
        rest = []
        for w in fresh:
            if w.isalpha() and w.isascii():
                ids = [t.id for t in tokens(w.decode())]
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(w)
        for w, e in zip(rest, self.exact.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            ids = e.ids
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return [self.known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def many(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each one's)."""
        n = len(offsets) - 1
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        whole = data.tobytes()
        special = {i for a in self.added for i in self._holders(whole, a, offsets)} if self.by_words else range(n)
        parts = {i: self.whole(whole[offsets[i] : offsets[i + 1]]) for i in special}
        if len(parts) == n:
            ids = [parts[i] for i in range(n)]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)
        codes, words, per_text = self._words(offsets, data)
        found = self._of_words(words)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        ids, lengths = flat[C.ranges(begin[codes], size[codes])], size[codes]
        ends = np.cumsum(np.r_[0, lengths])[np.cumsum(np.r_[0, per_text])]
        counts = np.diff(ends)
        if parts:
            pieces = [parts[i] if i in parts else ids[ends[i] : ends[i + 1]] for i in range(n)]
            ids, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return ids, counts

    @staticmethod
    def _holders(whole: bytes, part: bytes, offsets: np.ndarray) -> Iterator[int]:
        at = whole.find(part)
        while at >= 0:
            yield int(np.searchsorted(offsets, at, side="right")) - 1
            at = whole.find(part, at + 1)

    @staticmethod
    def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(code of each word, distinct words, words of each text). Words end at white space, and between a letter and a sign of ASCII, where no token of the pattern goes on.

        A capital before another byte of ASCII is made small; before others it may be composed first.
        """
        if not len(data):
            return np.zeros(0, np.int64), [], np.zeros(len(offsets) - 1, np.int64)
        kind = _KIND[data]
        first = np.zeros(len(data), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        inner = kind != SPACE
        begins = inner.copy()
        begins[1:] &= (kind[:-1] == SPACE) | first[1:] | ((kind[:-1] >= SMALL) & (kind[1:] == SIGN))
        ends = inner.copy()
        ends[:-1] &= (kind[1:] == SPACE) | begins[1:]
        capital = kind == CAPITAL
        capital[:-1] &= (data[1:] < 128) | first[1:]
        kept = (data | (capital.view(np.uint8) << 5))[inner]
        at = np.flatnonzero(begins)
        place = np.r_[0, np.cumsum(np.flatnonzero(ends) + 1 - at)]
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        per_text = np.diff(np.searchsorted(at, offsets))
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), per_text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokenizer: str | None = None, files: int | None = None) -> None:
    """The ids of each row's whole text (null: none) and end_id, to path/tokens in ascending order of id_col (nulls first), and path/index.

    Rows that share an id lie in the order of their texts; repeated rows each have theirs. Other columns aren't read. files:
    as many as shuffle partitions if not given. Rows are sorted by range, so a task's part grows with its range alone.
    """
    spark = docs.sparkSession
    file = tokenizer or default_tokenizer()
    files = files or C.shuffle_partitions(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in C.batches_of(batches, 6 << 20):
            ids, counts = encoder(file).many(*C.utf8_column(b.column(1)))
            ends = np.cumsum(counts + 1)
            out = np.full(len(ids) + len(counts), end_id, np.int32)
            inner = np.ones(len(out), bool)
            inner[ends - 1] = False
            out[inner] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends - counts - 1), pa.array(counts + 1), lists], names=["id", "part", "start", "n_tokens", "ids"])
            before += int(ends[-1]) if len(ends) else 0

    ordered = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
    coded = ordered.mapInArrow(run, f"id {kind}, part int, start long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_INDEX, "orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": BLOOM_FPP}
    coded.write.options(**options).orc(f"{path}/tokens")
    parts = spark.read.orc(f"{path}/tokens").groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    # A row a file.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.withColumn("base", before).coalesce(1).write.orc(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", ids: list | None = None) -> DataFrame:
    """id_col, start (ids of all documents before it), n_tokens, ids (array of int). ids: of these documents alone; stripes and row groups that can't hold them aren't read."""
    rows = spark.read.orc(f"{path}/tokens")
    if ids is not None:
        rows = rows.filter(F.col("id").isin(ids))
    bases = spark.read.orc(f"{path}/index").select("part", "base")  # a row for each file
    return rows.join(F.broadcast(bases), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows of read_token_files with ids_crc32, of all ids as little-endian unsigned 32-bit integers, in their place."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
            sums = [zlib.crc32(values[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return rows.select(id_col, "start", "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files as read back: doc_id, start, n_tokens, ids_crc32."""
    path = C.scratch_path(spark, "tokens")
    write_token_files(C.table(spark, sf_dir, "documents"), path)
    return checksums(read_token_files(spark, path))
