"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives each document's posterior over domains. Document rates r >= least are fitted so
that the expected tokens of each domain, the sum of r * tokens * posterior, match targets in the least-squares sense, with a
small ridge that keeps rates near 1 where targets leave a choice:

    (1/2) |sum r x - goal|^2 + (ridge / 2) sum of tokens * (r - 1)^2,   x = tokens * posterior.

Projected gradient steps, lazily projected: a step moves a row's rate by its posterior times the domains' misses (its
gradient over its tokens), all steps so far add up to one vector s of the size of the domains, and the rate is the
projection, r = max(least, 1 - posterior . s). So rates are never stored, a pass costs the same at each step, and a lost
executor's rows are computed again from the same numbers. A pass is one aggregation of a few numbers a domain with map-side
sums. Steps are scaled by the curvature of the rows that can move; a pass tries several lengths and a step that makes
the (dual) objective worse is not taken. The ridge starts large and falls by tenths, which keeps steps safe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .hashed import sampled_features

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 3_000
BITS = 15
#: Passes at most, and the lengths of a step that each tries.
STEPS, LENGTHS = 80, (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3)
#: The ridge as a share of the largest curvature, at first and at last. A smaller one comes nearer to targets that can't be met, by larger rates of a few documents.
RIDGE_FROM, RIDGE = 1e-3, 1e-6
#: Shares of tokens that the mixture is to have; domains without one share what is left.
TARGETS = {"en": 0.50, "fr": 0.15, "de": 0.15, "es": 0.15, "poor": 0.03, "toxic": 0.02}
#: Where rates can't fall below 1, the shares of the domains that are wanted.
WANTED = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15, "poor": 0.0, "toxic": 0.0}


def text_features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Hashed ids of the distinct words of a text and of their endings of 3 bytes, in lower case."""
    words = set(text.lower().split())
    ids = [crc32(w) for w in words] + [crc32(x, 3) for x in {w[-3:] for w in words}]
    return (np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)).astype(np.int32)


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posterior(self, text: bytes) -> np.ndarray:
        ids = text_features(text)
        x = self.bias + (self.weights[ids].sum(axis=0) / np.sqrt(len(ids)) if len(ids) else 0)
        e = np.exp(x - x.max())
        return e / e.sum()


def fit_domains(docs: DataFrame, labelled: DataFrame, domain: str = "domain", sample: int = SAMPLE, rounds: int = 100, rate: float = 0.15, ridge: float = 1e-4) -> DomainModel:
    """Multinomial logistic regression on at most sample labelled rows (doc_id, domain), over all domains that these have; without any, one domain, "other"."""
    names, ids, starts = sampled_features(docs, labelled, domain, sample, features=text_features)
    if not len(names):
        return DomainModel(["other"], np.zeros((1 << BITS, 1)), np.zeros(1))
    domains, y = np.unique(names.astype(str), return_inverse=True)
    n, k = len(y), len(domains)
    scale = (1 / np.sqrt(np.maximum(np.diff(starts), 1)))[:, None]
    rows = np.repeat(np.arange(n), np.diff(starts))
    # Sums by row and by feature run over entries that are sorted by these; features of one row tell nothing.
    seen = np.bincount(ids, minlength=1 << BITS)
    kept = seen[ids] > 1
    rows, ids = rows[kept], ids[kept]
    by = np.argsort(ids, kind="stable")
    feature, feature_at = np.unique(ids[by], return_index=True)
    row, row_at = np.unique(rows, return_index=True)
    column, rows_by = np.searchsorted(feature, ids), rows[by]
    w, b = np.zeros((len(feature), k)), np.log((np.bincount(y, minlength=k) + 1) / (n + k))
    m, v = np.zeros_like(w), np.zeros_like(w)
    truth = np.eye(k)[y]
    for t in range(1, rounds + 1):
        x = np.tile(b, (n, 1))
        if len(feature):
            x[row] += np.add.reduceat(w[column], row_at) * scale[row]
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        err = (p - truth) / n
        if len(feature):
            g = np.add.reduceat((err * scale)[rows_by], feature_at) + ridge * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= rate * err.sum(axis=0)
    weights = np.zeros((1 << BITS, k), np.float32)
    weights[feature] = w
    return DomainModel([str(d) for d in domains], weights, b)


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (words between ASCII space, long) and posterior (array, in model.domains' order). Null texts are empty; the posterior of an empty text is the classifier's prior."""
    rest = [c for c in docs.columns if c not in ("n_tokens", "posterior")]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.batches_of(batches, 16 << 20):
            offsets, data = C.utf8_column(b.column(at))
            view, edges = memoryview(data), offsets.tolist()
            texts = [bytes(view[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x.split()) for x in texts], pa.int64()), pa.array([model.posterior(x) for x in texts], pa.list_(pa.float64()))], names=[*rest, "n_tokens", "posterior"])

    schema = T.StructType(list(docs.schema.fields)).add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(run, schema)


def _rates(p: np.ndarray, s: np.ndarray, least: float) -> np.ndarray:
    return np.maximum(least, 1 - p @ s)


def fit_rates(members: DataFrame, targets: np.ndarray, least: float = 0.0, ridge: float = RIDGE, tolerance: float = 1e-4) -> np.ndarray:
    """s, by which a row's rate is max(least, 1 - posterior . s). members: n_tokens and posterior, read once a pass. targets: expected tokens by domain. least: at most 1."""
    if not 0 <= least <= 1:
        raise ValueError("least must be from 0 to 1")
    k = len(targets)
    width = 1 + k + k * k

    def passed(tries: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each try: the sum over rows of what the dual objective takes, the domains' totals and the curvature of rows that can move."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(tries), width))
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                tokens = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                for at, s in enumerate(tries):
                    u = p @ s
                    moves = 1 - u >= least
                    value = np.where(moves, u * u / 2 - u, -least * u - (1 - least) ** 2 / 2)
                    live = p[moves] * tokens[moves, None]
                    sums[at] += np.r_[tokens @ value, (np.maximum(least, 1 - u) * tokens) @ p, (live.T @ p[moves]).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["v"])

        parts = members.select("n_tokens", "posterior").mapInArrow(run, "v array<double>")
        got = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a few numbers for each pair of domains
        flat = np.zeros(len(tries) * width)
        for r in got:
            flat[r["i"]] = r["x"]
        return [(float(v[0]), v[1 : 1 + k], v[1 + k :].reshape(k, k)) for v in flat.reshape(len(tries), width)]

    s = np.zeros(k)
    value, totals, curve = passed([s])[0]
    top = float(np.linalg.eigvalsh(curve)[-1]) if curve.any() else 0.0
    if top <= 0:
        return s
    best, nearest = s, float(np.linalg.norm(totals - targets))
    weight = RIDGE_FROM * top
    for _ in range(STEPS):
        objective = value + targets @ s + weight / 2 * s @ s
        step = np.linalg.solve(curve + weight * np.eye(k), totals - targets - weight * s)
        tries = [s + length * step for length in LENGTHS]
        found = passed(tries)
        after = [v + targets @ x + weight / 2 * x @ x for x, (v, _, _) in zip(tries, found, strict=True)]
        i = int(np.argmin(after))
        size = abs(objective) + abs(targets @ s)
        if after[i] < objective - 1e-9 * size:
            s, (value, totals, curve) = tries[i], found[i]
            miss = totals - targets
            if (now := float(np.linalg.norm(miss))) < nearest:
                best, nearest = s, now
            if np.abs(miss).max() <= tolerance * max(targets.max(), 1e-9):
                break
            if objective - after[i] > 1e-5 * size:
                continue
        if weight <= ridge * top * 1.0001:
            break
        weight = max(weight / 10, ridge * top)
    return best


def target_tokens(domains: list[str], weights: dict[str, float], totals: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Expected tokens by domain: shares by weights. Of all tokens that there are; where least keeps rates from falling, of the fewest for which no domain with a share has to shrink. Domains without a weight share evenly what the others leave."""
    known = np.array([weights.get(d, -1.0) for d in domains])
    left = max(1 - known[known > 0].sum(), 0.0)
    share = np.where(known >= 0, known, left / max((known < 0).sum(), 1))
    share = share / share.sum() if share.sum() > 0 else np.full(len(domains), 1 / len(domains))
    size = totals.sum() if least < 1 else (totals / np.maximum(share, 1e-12))[share > 0].max()
    return share * float(size)


def mix(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, least: float = 0.0, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", ridge: float = RIDGE) -> DataFrame:
    """docs with n_tokens, posterior, rate and copies (int: rate, rounded up or down by a hash of the row's id, its text and seed).

    The sum over domains of squared misses of the targets is least among rates of least or more, up to the ridge. Repeated
    rows have equal rates and copies; null texts are empty and have the prior's rate; an empty table gives an empty one.
    Columns of docs may have any name; those named like an output are replaced.
    """
    members = C.materialize(with_posteriors(docs.drop("rate", "copies"), model, text_col), "posteriors")
    k = len(model.domains)
    sums = members.agg(*(F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"v{i}") for i in range(k)), F.count("*").alias("n")).first()
    totals = np.array([sums[i] or 0.0 for i in range(k)])
    # What the passes read is written apart, in few and larger files.
    small = C.materialize(members.select("n_tokens", "posterior").coalesce(max(1, sums["n"] // 50_000)), "memberships")
    s = fit_rates(small, target_tokens(model.domains, weights or TARGETS, totals, least), least, ridge)
    C.release(small)
    names = members.columns
    at = names.index("posterior")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_rates(b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), s, least))], names=[*names, "rate"])

    rated = members.mapInArrow(run, T.StructType(list(members.schema.fields)).add("rate", "double"))
    uniform = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + uniform).cast("int"))


def label_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the documents that the labels table rates: "poor" or "toxic" where it says so, else the document's language (none: not labelled)."""
    rated = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    lang = F.lower(F.trim("lang")) if "lang" in docs.columns else F.lit("clean")
    named = docs.select("doc_id", lang.alias("lang")).join(rated, "doc_id")
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("lang") != ""), F.col("lang"))
    return named.select("doc_id", domain.alias("domain")).filter("domain is not null")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, posterior, rate, copies."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit_domains(docs, label_domains(docs, C.table(spark, sf_dir, "labels")))
    return mix(docs.select("doc_id", "text"), model).select("doc_id", "n_tokens", "posterior", "rate", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies say, and once at least; the columns are those of docs. A larger ridge keeps copies few."""
    model = fit_domains(docs, label_domains(docs, C.table(spark, sf_dir, "labels")))
    return mix(docs, model, WANTED, least=1.0, ridge=1e-4).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)
