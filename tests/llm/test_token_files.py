"""Token files against the tokenizer's own ids, and their metadata."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from plinth.llm import token_files as T

ALPHABET = ["a", "B", "J", "̌", "'s", "'T", "'", '"', "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "\x1c", "\x85", "\xa0", "É", "e", "́", "1", "９", "İ", "Σ", "ς", "ß", "中", "😀", ">", "̸", "'re", "LL", "-", "_", "‍", "K", "Å", "̧", "ﬁ", "ǰ", "²", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_tokenizer())


def ids_of(library, text, end=2):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_words_give_the_ids_of_whole_texts(library, monkeypatch):
    encoder = T.Encoder(T.default_tokenizer())
    assert encoder.by_words
    monkeypatch.setattr(T, "MOST_WORDS", 300)
    rng = random.Random(3)
    for _ in range(1200):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        column = pa.array(texts)
        ids, many = encoder.many(*T.C.utf8_column(column))
        want = [library.encode(x, add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == sum(want, []) and many.tolist() == list(map(len, want)), texts


def test_a_tokenizer_that_needs_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = T.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.by_words
    ids, many = encoder.many(*T.C.utf8_column(pa.array(["Some words  here", "", None, "é\n\n"])))
    want = [library.encode(x, add_special_tokens=False).ids for x in ("Some words  here", "", "", "é\n\n")]
    assert ids.tolist() == sum(want, []) and many.tolist() == list(map(len, want))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["Hello", "world,", "it's", "naïve", "2024", "😀", "x" * 300, "<|endoftext|>"]
    out = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), 1, "p") for i in range(400)]
    out += [(9, "same id", 1, ""), (9, "same id", 1, ""), (None, "no id", 1, ""), (None, None, 1, ""), (5000, "", 1, ""), (5001, "é" * 200_000, 1, "")]
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, start int, part string"


def test_round_trip(spark, rows, library, tmp_path):
    path = f"file://{tmp_path}/t"
    T.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), path, files=5)
    back = T.read_token_files(spark, path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for r in order:
        ids = ids_of(library, r[1])
        want.append((r[0], at, len(ids), ids))
        at += len(ids)
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[1]) == want
    sums = {(r["start"], r["ids_crc32"]) for r in T.checksums(back).collect()}
    assert sums == {(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, _, ids in want}
    index = sorted(spark.read.orc(f"{path}/index").collect(), key=lambda r: r["part"])
    assert sum(r["tokens"] for r in index) == at and [r["base"] for r in index] == np.cumsum([0, *(r["tokens"] for r in index[:-1])]).tolist()


def test_stripes_and_pruning(spark, library, tmp_path):
    docs = spark.range(60_000).selectExpr("id * 2 as doc_id", "concat('word ', id, ' and more text of number ', id % 977) as text")
    path = f"file://{tmp_path}/t"
    T.write_token_files(docs, path, files=4)
    files = [orc.ORCFile(f) for f in sorted(glob.glob(f"{tmp_path}/t/tokens/*.orc"))]
    assert len(files) == 4 and sum(f.nrows for f in files) == 60_000
    size = sum(f.content_length for f in files)
    assert size < 0.7 * 4 * spark.read.orc(f"{path}/index").agg({"tokens": "sum"}).first()[0]  # under the ids as plain integers
    got = T.read_token_files(spark, path, ids=[40_000, 40_001]).collect()  # one is there, one isn't
    assert [r["doc_id"] for r in got] == [40_000] and got[0]["ids"] == ids_of(library, "word 20000 and more text of number 460")
    plan = T.read_token_files(spark, path, ids=[40_000])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [40000])" in plan or "EqualTo(id,40000)" in plan
    found = spark.read.orc(f"{path}/tokens").filter("id = 40000")
    found.collect()
    from pyspark.sql import functions as F

    read = spark.read.orc(f"{path}/tokens").filter("id = 40001").select(F.count("*")).first()[0]
    assert read == 0


def test_split_of_one_file_reads_each_row_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(concat(uuid(), ' '), 30) as text")
    before = (T.STRIPE_BYTES, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    T.STRIPE_BYTES = 1 << 16
    try:
        T.write_token_files(docs, path, files=1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
        rows = spark.read.orc(f"{path}/tokens")
        assert rows.rdd.getNumPartitions() > 1 and rows.select("id").distinct().count() == 4000
    finally:
        T.STRIPE_BYTES = before[0]
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])


def test_empty_and_text_ids(spark, library, tmp_path):
    T.write_token_files(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert T.read_token_files(spark, f"file://{tmp_path}/e").collect() == []
    T.write_token_files(spark.createDataFrame([("b", "two"), ("a", "one")], "name string, body string"), f"file://{tmp_path}/s", "name", "body", end_id=7)
    got = sorted(map(tuple, T.read_token_files(spark, f"file://{tmp_path}/s", "name").collect()))
    assert got == [("a", 0, 2, ids_of(library, "one", 7)), ("b", 2, 2, ids_of(library, "two", 7))]
