"""Phrases whose words keep together, by language.

1. Shards of text count their n-grams in a sketch: one row of cells, as many as the corpus has bytes / 8 up to MOST_CELLS.
   Cells travel by slices, saturated at the threshold, and are summed; a cell's sum is an upper bound for each of its
   phrases. What is left is a bit for each cell that reaches the threshold: 128 MB at most, which is broadcast.
2. A shard's candidates are the phrases whose cells, and whose two shorter phrases' cells, reach it. They are compiled,
   with a space at each end, into an Aho-Corasick automaton, which scans the shard and counts overlapping matches. An
   automaton holds phrases of its shard alone, so that its size is bounded by the shard's, whatever the corpus.
3. Counts are summed over the shards, and the thresholds apply to the exact sums.

The sketch only keeps rare phrases from being shuffled: where cells are few for a corpus it lets more of them through, and
the result is the same.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LONGEST, LEAST, TOP = 5, 100, 2000
SHARD_BYTES = 16 << 20
#: Cells of the sketch, at most and in a slice.
MOST_CELLS, SLICE = 1 << 30, 1 << 16
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(_ENDS))
_GAPS, _BLANKS = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Shard:
    """Texts of one language as words: small letters, one space before and after each word; a line end stands between pieces as if it were a word."""

    def __init__(self, lang: str, texts: list[bytes]):
        data = b"\n".join(texts).translate(_PLAIN)
        data = _BLANKS.sub(b" ", _GAPS.sub(b" \n ", data)).strip(b" \n")
        self.lang = lang
        self.text = b" " + data + b" " if data else b" "
        self.space = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        n = len(self.space) - 1
        coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((self.space + 1).astype(np.int64)), pa.py_buffer(self.text)]).dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.array([w == b"\n " for w in self.words], bool)[self.codes] if n else np.zeros(0, bool)

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hash of the phrase that begins at each word, whether it lies within a piece) from two words on."""
        import xxhash

        seed = zlib.crc32(self.lang.encode())
        own = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)[self.codes]
        whole = ~self.ends
        h, inside = own, whole
        for k in range(2, longest + 1):
            if len(own) < k:
                return
            h = h[:-1] * _ODD + own[k - 1 :]
            h ^= h >> np.uint64(29)
            h *= _MIX
            h ^= h >> np.uint64(32)
            inside = inside[:-1] & whole[k - 1 :]
            yield k, h, inside

    def key(self, at: int, k: int) -> bytes:
        return self.text[self.space[at] : self.space[at + k] + 1]


def shards(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[Shard]:
    """Of batches of (lang, text), in order, a shard for each language of about most_bytes of text in all."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in C.batches_of(batches, most_bytes):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= most_bytes:
                for x in list(held):
                    yield Shard(x, held.pop(x))
                size = 0
    for x in list(held):
        yield Shard(x, held.pop(x))


def _sketched(bits: int, longest: int, least: int, shard_bytes: int):
    """(slice, low and high bytes of cells, counts) of each shard; counts stop at least, which at most is 127."""
    schema = pa.schema([("slice", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            cells = [(h[inside] >> np.uint64(64 - bits)).astype(np.uint32) for _, h, inside in shard.hashes(longest)]
            if not sum(map(len, cells)):
                continue
            every = np.concatenate(cells)
            every.sort()
            start, many = C.runs(every)
            cell, many = every[start], np.minimum(many, least).astype(np.uint8)
            part = (cell >> np.uint32(16)).astype(np.int32)
            first, _ = C.runs(part)
            planes = ((cell & np.uint32(255)).astype(np.uint8), (cell >> np.uint32(8) & np.uint32(255)).astype(np.uint8), many)
            for lo in range(0, len(first), 256):
                cut = np.r_[first, len(cell)][lo : lo + 257]
                offsets = pa.py_buffer((cut - cut[0]).astype(np.int32))
                columns = [pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, offsets, pa.py_buffer(p[cut[0] : cut[-1]])]) for p in planes]
                yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *columns], schema=schema)

    return run


def _merged(least: int):
    """Rows of a slice come one after another; a bit for each of its cells that reaches least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, np.zeros(SLICE, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["slice", "bits"])

        for b in batches:
            for part, low, high, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part != own:
                    if own is not None:
                        yield done()
                    own, total = part, np.zeros(SLICE, np.uint8)
                at = np.frombuffer(low, np.uint8) | np.frombuffer(high, np.uint8).astype(np.uint16) << 8
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), least)
        if own is not None:
            yield done()

    return run


def upper_bounds(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, most_cells: int = MOST_CELLS, shard_bytes: int = SHARD_BYTES) -> tuple[int, bytes]:
    """(bits of a cell's number, a bit for each cell whose sum reaches least): no phrase of texts (lang, text) that occurs least times has its bit unset."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(SLICE.bit_length() - 1, min(max(1, size // 8).bit_length(), most_cells.bit_length() - 1))
    cells = texts.mapInArrow(_sketched(bits, longest, min(least, 127), shard_bytes), "slice int, low binary, high binary, counts binary")
    slices = cells.repartition(C.shuffle_partitions(texts.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(_merged(min(least, 127)), "slice int, bits binary")
    out = np.zeros(1 << bits >> 3, np.uint8)
    step = SLICE >> 3
    for r in slices.toLocalIterator():  # 2**bits / 8 bytes in all
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return bits, out.tobytes()


def candidates(shard: Shard, bits: int, heavy: np.ndarray, longest: int) -> list[bytes]:
    """The shard's distinct phrases that may reach the threshold, with a space at each end."""
    found: list[bytes] = []
    shorter = shard.codes
    for k, h, inside in shard.hashes(longest):
        cell = h >> np.uint64(64 - bits)
        good = inside & ((heavy[(cell >> np.uint64(3)).astype(np.int64)] << (cell & np.uint64(7)).astype(np.uint8) & 128) > 0)
        if k > 2:
            good &= (shorter[:-1] >= 0) & (shorter[1:] >= 0)
        at = np.flatnonzero(good)
        _, first, group = np.unique(shorter[at] * len(shard.words) + shard.codes[at + k - 1], return_index=True, return_inverse=True)
        shorter = np.full(len(good), -1)
        shorter[at] = group
        found += [shard.key(i, k) for i in at[first].tolist()]
    return found


def scan(shard: Shard, phrases: list[bytes]) -> np.ndarray:
    """Occurrences of each phrase in the shard, overlapping ones included."""
    import ahocorasick

    if not phrases:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(p.decode("latin-1"), i)  # a character a byte
    automaton.make_automaton()
    hits = np.fromiter(map(itemgetter(1), automaton.iter(shard.text.decode("latin-1"))), np.int32)
    return np.bincount(hits, minlength=len(phrases))


def phrase_counts(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, most_cells: int = MOST_CELLS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, f) of texts (lang, text; neither null): phrases of 1 to longest words with f >= least, and for each language one row of no words with its number of words."""
    bits, heavy = upper_bounds(texts, longest, least, most_cells, shard_bytes)
    shared = texts.sparkSession.sparkContext.broadcast(heavy)
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for shard in shards(batches, shard_bytes):
            phrases = candidates(shard, bits, marks, longest)
            many = scan(shard, phrases)
            own = np.bincount(shard.codes, minlength=len(shard.words))
            single = [(w[:-1], n) for w, n in zip(shard.words, own.tolist(), strict=True) if w != b"\n "]
            words = [0, *[1] * len(single), *(p.count(b" ") - 1 for p in phrases)]
            names = [b"", *(w for w, _ in single), *(p[1:-1] for p in phrases)]
            counts = [sum(n for _, n in single), *(n for _, n in single), *many.tolist()]
            for at in range(0, len(words), 50_000):
                n = len(words[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * n), pa.array(words[at : at + n], pa.int32()), pa.array(names[at : at + n], pa.binary()).cast(pa.string()), pa.array(counts[at : at + n], pa.int64())], schema=schema)

    counted = texts.mapInArrow(run, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counted.filter((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, keep: int = 100) -> DataFrame:
    """The top phrases of 2 to longest words of each language: lang, rank, phrase, a, l, r, n, score.

    a: occurrences, least at least. score: the lowest of floor(1000 * a * n / (l * r)) over the cuts into two parts, with l
    and r as the parts' occurrences and n as the language's words; of equal cuts the first. A phrase is left out if a longer
    candidate holds it and 100 times the longer one's occurrences reach keep times its own. Null languages are `und`, null
    texts empty; rows that repeat count each. Other columns aren't read. An empty table gives an empty one.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = C.materialize(phrase_counts(texts, longest, least), "phrases")
    parts = known.filter("words >= 1").select("lang", "phrase", "f")
    candidate = known.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    each = F.split("phrase", " ")
    cut = F.col("k")
    cuts = candidate.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "words", "a", "k", F.array_join(F.slice(each, F.lit(1), cut), " ").alias("left"), F.array_join(F.slice(each, cut + 1, F.col("words") - cut), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    total = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    exact = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact[0] * exact[1], exact[2] * exact[3])
    scored = cuts.join(total, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")

    # A longer phrase that occurs as often holds the ones between, so its two parts of one word less are enough at keep = 100; else all its parts are.
    sizes = F.array(F.col("words") - 1) if keep >= 100 else F.sequence(F.lit(2), F.col("words") - 1)
    inner = candidate.filter("words >= 3").withColumn("size", F.explode(sizes)).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    held = inner.select("lang", F.array_join(F.slice(each, F.col("at"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = lowest.join(held, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < {} * a".format(keep))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # limited by task before it is shuffled
    ranked = own.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language its first 2000 phrases: lang, rank, phrase, a, l, r, n, score."""
    return collocations(C.table(spark, sf_dir, "documents"))
