"""Encoders and rerankers: what a model has to offer, and deterministic defaults without one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, WIDTH = 8000, 64
Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Signed hashed word counts, of length one."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text[:MAX_CHARS].lower().split():
            h = hashlib.sha256(word.encode()).digest()
            row[int.from_bytes(h[:4], "big") % width] += 1 if h[4] & 1 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def encode_column(encoder: Encoder = hashed_encoder):
    """A pandas UDF; the encoder gets batches of similar length, and rows keep their order."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("")
            order = np.argsort(texts.str.len().to_numpy(), kind="stable")
            vectors = np.empty(len(texts), object)
            got = encoder([texts.iloc[i] for i in order])
            for place, v in zip(order, got, strict=True):
                vectors[place] = v.astype(np.float32).tolist()
            yield pd.Series(vectors)

    return encode


def sparse_column(text: str, pattern: str = r"([a-z0-9]+)"):
    """map<int,double>: 1 + ln(count) by a hash of each term."""
    terms = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 1)
    ids = F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(1 << 30)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i, (1 + F.log(F.size(F.filter(ids, lambda j: j == i)).cast("double"))))))


def nonzero(vector: str):
    """map<int,double> of a dense vector's components that aren't zero."""
    pairs = F.transform(F.col(vector), lambda x, i: F.struct(i, x.cast("double")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["col2"] != 0))


@lru_cache(maxsize=128)
def query_vector(text: str, surface: str = "vault", prompt: str = "") -> tuple[float, ...]:
    return tuple(float(x) for x in hashed_encoder([prompt + text])[0])


def encode_table(df: DataFrame, text: str, encoder: Encoder = hashed_encoder) -> DataFrame:
    """df with dense and sparse columns of its text; both go with the row, so nothing is matched by place."""
    return df.withColumns({"dense": encode_column(encoder)(F.col(text)), "sparse": sparse_column(text)})


def quantized(vector: str):
    """(scale, array of bytes): components by steps of the largest one's 127th part."""
    top = F.array_max(F.transform(F.col(vector), lambda x: F.abs(x).cast("double")))
    return F.struct((top / 127).alias("scale"), F.transform(F.col(vector), lambda x: F.when(top > 0, F.round(x.cast("double") / top * 127)).otherwise(0).cast("tinyint")).alias("codes"))
