"""Language ID of web pages by Bayesian evidence fusion.

log P(language | page) = prior by host + likelihood of the text + likelihoods of the declared language and of the address'
suffix, up to a constant.

* Text: hashed byte n-grams of the text without markup; their rates per language are counted on a bounded sample of texts
  of known language, and their sum is tempered, as neighbouring n-grams aren't independent.
* Declaration and suffix: P(declared | language) and P(suffix | language) are counted over all pages, weighted by the text's posterior.
* Host prior: shrunk to that of the host's site (last two labels), and that to the prior of all pages; all three are grouped
  aggregations of the posteriors from text, with map-side sums, so that a host of any size is a few rows per task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documents of known language from which n-gram rates are counted, at most.
SAMPLE = 6_000
BITS = 16
GRAMS = (1, 2, 3, 4)
#: Share of an n-gram's log likelihood that counts, and the n-grams of a text beyond which further ones count less and less.
TEMPER, FULL = 0.1, 4000
#: Pseudo-counts with which a host is shrunk to its site, a site to all pages, and evidence tables to even rates.
SHRINK = 20.0

_DROPPED = re.compile(rb"<!--.*?-->|<(script|style|noscript|template|nav|footer)\b.*?</\1\s*>|<head\b.*?</head\s*>|<[^>]*>", re.S | re.I)
_SPACE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def visible_text(html: bytes) -> bytes:
    return _DROPPED.sub(b" ", html)


def gram_ids(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed ids of the n-grams of a text's letters, in lower case, words apart by one space."""
    letters = np.frombuffer(b" " + _SPACE.sub(b" ", text.lower()).strip() + b" ", np.uint8).astype(np.uint32)
    out = []
    rolled = np.zeros(len(letters), np.uint32)
    for k in range(1, max(GRAMS) + 1):
        if len(letters) < k:
            break
        rolled = rolled[: len(letters) - k + 1] * np.uint32(0x01000193) + letters[k - 1 :]
        if k in GRAMS:
            mixed = (rolled ^ np.uint32(k * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    rates: np.ndarray  # log P(gram | language), languages x grams

    def scores(self, text: bytes) -> np.ndarray:
        ids = gram_ids(text)
        if len(ids) <= 2 * len(GRAMS):
            return np.zeros(len(self.languages))
        # Evidence grows with a text, but slowly for a long one, whose n-grams are of few kinds.
        return TEMPER * self.rates[:, ids].mean(axis=1) * FULL * math.log1p(len(ids) / FULL)


def fit_text_model(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE) -> TextModel:
    """Counts n-grams of at most rows texts, those of the smallest hashes of their ids, by language, of which none is left out; counts are merged by the executors' tasks."""
    known = texts.filter(F.col(lang_col).isNotNull() & (F.trim(lang_col) != "")).select(F.lower(F.trim(lang_col)).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not names:
        return TextModel([], np.zeros((0, 1 << BITS)))
    edge = known.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = known.filter(F.col("h") <= edge)
    at = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 << BITS), np.int64)
        for b in C.batches_of(batches, 8 << 20):
            offsets, data = C.utf8_column(b.column(1))
            for lang, s, e in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                total[at[lang]] += np.bincount(gram_ids(data[s:e].tobytes()), minlength=1 << BITS)
        row, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(total[row, gram])], names=["row", "gram", "n"])

    merged = sample.select("lang", "text").mapInArrow(count, "row int, gram int, n long").groupBy("row", "gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((len(names), 1 << BITS), 0.5)
    total[merged["row"].to_numpy(), merged["gram"].to_numpy()] += merged["n"].to_numpy()
    return TextModel(names, np.log(total / total.sum(axis=1, keepdims=True)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def evidence_columns(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """pages with _host, _site, _declared and _suffix, each empty where there is none. The suffix is the path's first part if it is a language code, else the host's last label."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    labels = F.split(host, r"\.")
    site = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    in_path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return pages.withColumns({"_host": host, "_site": site, "_declared": F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), _DECLARED, 1)), "_suffix": F.when(in_path != "", F.concat(F.lit("/"), in_path)).otherwise(F.concat(F.lit("."), F.element_at(labels, -1)))})


def _sums(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(f"{key}_n"), F.array(*(F.sum(F.col("_text")[i]) for i in range(k))).alias(f"{key}_p"))


def identify_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id_col, lang, probability, text_lang, declared, host and posterior (array, in model.languages' order).

    Null addresses and pages are empty and give no evidence: such a row gets the prior. Without languages, lang is null.
    Ties go to the first language by name. Repeated rows count each in the priors and get equal results. Pages of any
    length are read whole; other columns of pages, of any name, are not read.
    """
    spark, k = pages.sparkSession, len(model.languages)
    ready = evidence_columns(pages.select(id_col, url_col, html_col), url_col, html_col)
    if not k:
        return ready.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.col("_declared").alias("declared"), F.col("_host").alias("host"), F.array().cast("array<double>").alias("posterior"))
    kind = pages.schema[id_col].dataType.simpleString()

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches_of(batches, 8 << 20):
            offsets, data = C.utf8_column(b.column(5))
            scores = np.array([model.scores(visible_text(data[s:e].tobytes())) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(list(scores), pa.list_(pa.float64())), pa.array(list(_softmax(scores)), pa.list_(pa.float64()))], names=[id_col, "_host", "_site", "_declared", "_suffix", "_score", "_text"])

    read = ready.select(id_col, "_host", "_site", "_declared", "_suffix", F.col(html_col).alias("html")).mapInArrow(text, f"`{id_col}` {kind}, _host string, _site string, _declared string, _suffix string, _score array<double>, _text array<double>")
    rows = C.materialize(read, "text_evidence")
    whole = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("_text")[i]).alias(f"p{i}") for i in range(k))).first()
    prior = (np.array([whole[f"p{i}"] or 0.0 for i in range(k)]) + 1) / ((whole["n"] or 0) + k)

    def vector(parts: list) -> F.Column:
        return F.array(*parts)

    even = [F.lit(float(x)) for x in prior]
    hosts, sites = _sums(rows, "_host", k), _sums(rows, "_site", k)
    declared, suffixes = _sums(rows, "_declared", k), _sums(rows, "_suffix", k)
    out = rows
    for table, key in ((hosts, "_host"), (sites, "_site"), (declared, "_declared"), (suffixes, "_suffix")):
        out = out.join(table, key)
    # A row's own text counts once: its share is taken out of its host's and site's sums.
    own = [F.col("_text")[i] for i in range(k)]
    site_p = [(F.col("_site_p")[i] - own[i] + SHRINK * even[i]) / (F.col("_site_n") - 1 + SHRINK) for i in range(k)]
    host_p = [(F.col("_host_p")[i] - own[i] + SHRINK * site_p[i]) / (F.col("_host_n") - 1 + SHRINK) for i in range(k)]
    total = float(whole["n"] or 0)

    def likelihood(key: str, i: int) -> F.Column:
        """log P(value | language) against P(value); none for a missing value."""
        joint = F.greatest(F.col(f"{key}_p")[i] - own[i], F.lit(0.0))
        seen = F.greatest(F.col(f"{key}_n") - 1, F.lit(0))
        given = (joint + SHRINK * (seen / total) * even[i]) / (F.lit(total) * even[i] + SHRINK * even[i])
        return F.when((F.col(key) == "") | (F.col(key) == ".") | (seen == 0), F.lit(0.0)).otherwise(F.log(F.greatest(given, F.lit(1e-9))) - F.log(seen / total))

    fused = vector([F.log(F.greatest(host_p[i], F.lit(1e-9))) + F.col("_score")[i] + likelihood("_declared", i) + likelihood("_suffix", i) for i in range(k)])
    out = out.withColumn("_fused", fused)
    top = F.array_max("_fused")
    weights = F.transform("_fused", lambda x: F.exp(x - top))
    out = out.withColumn("_w", weights).withColumn("posterior", F.transform("_w", lambda x: x / F.aggregate("_w", F.lit(0.0), lambda a, y: a + y)))
    names = F.array(*map(F.lit, model.languages))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return out.select(id_col, F.element_at(names, best).alias("lang"), F.array_max("posterior").alias("probability"), F.element_at(names, F.array_position("_text", F.array_max("_text")).cast("int")).alias("text_lang"), F.col("_declared").alias("declared"), F.col("_host").alias("host"), "posterior")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, lang, probability, text_lang, declared, host."""
    model = fit_text_model(C.table(spark, sf_dir, "documents"))
    return identify_languages(C.table(spark, sf_dir, "pages"), model).select("page_id", "lang", "probability", "text_lang", "declared", "host")
