"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score into grades:
P(grade > k) = sigmoid(score - threshold[k]). Selection is by the tail probability of the highest grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .hashed import BITS, all_features, row_sums, sampled_features, shape_ids, telling

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def over(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def ordinal_slopes(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray, row_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(slope of the log likelihood by each row's score, of its negative by each threshold, the log likelihood)."""
    edges = np.r_[-np.inf, cuts, np.inf]
    a, b = _sigmoid(edges[grades] - score), _sigmoid(edges[grades + 1] - score)
    da, db = a * (1 - a), b * (1 - b)
    p = np.maximum(b - a, 1e-9)
    by_cut = np.array([-(row_weight * np.where(grades == k, db, np.where(grades == k + 1, -da, 0)) / p).sum() for k in range(len(cuts))])
    return row_weight * (da - db) / p, by_cut, float((row_weight * np.log(p)).sum())


def fit_ordinal(grades: np.ndarray, ids: np.ndarray, starts: np.ndarray, levels: int, bits: int = BITS, rounds: int = 400, rate: float = 0.08, ridge: float = 1e-4, evidence: float = 25.0, lift: float = 4.0) -> OrdinalModel:
    """By gradient steps with momentum and per-weight scaling. Rare grades count more.

    A word counts against a text only, as long texts hold many words: it has a weight if some grade under the highest is
    lift times as frequent with it as in the sample, by a chi-squared of evidence or more. Weights of shapes are free.
    """
    n = len(grades)
    share = np.bincount(grades, minlength=levels) / n
    found, lifts = telling(ids, np.repeat(grades.astype(np.int8), np.diff(starts)), share, bits)
    shapes = shape_ids(bits)
    keep = (found >= evidence) & (lifts[:-1].max(axis=0) >= lift)
    keep[shapes] = np.bincount(ids, minlength=1 << bits)[shapes] >= 5
    words = keep.copy()
    words[shapes] = False
    used = keep[ids]
    starts = np.r_[0, np.cumsum(used)][starts]
    ids = ids[used]
    row_weight = 1 / np.sqrt(np.maximum(share[grades], 1e-9))
    row_weight /= row_weight.sum()
    rows = np.repeat(np.arange(n), np.diff(starts))
    w = np.zeros(1 << bits)
    first = np.cumsum(share)[:-1].clip(1e-3, 1 - 1e-3)
    cuts = np.log(first / (1 - first))
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)
    for t in range(1, rounds + 1):
        score = row_sums(w[ids], starts)
        slope, grad_cuts, _ = ordinal_slopes(score, cuts, grades, row_weight)
        grad = -np.bincount(ids, slope[rows], minlength=len(w)) + ridge * w
        for x, g, mm, vv in ((w, grad, m, v), (cuts, grad_cuts, mc, vc)):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-8) * (0.1 ** (t / rounds))
        np.minimum(w, 0, out=w, where=words)
        # Thresholds stay in order; one that would pass another stops there.
        ordered = np.maximum.accumulate(cuts)
        mc[ordered != cuts] = 0
        cuts[:] = ordered
    return OrdinalModel(np.where(keep, w, 0).astype(np.float32), cuts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score_quality(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs with expected_grade and tail_probability (of the highest grade), by whole texts. Null texts are empty; without a model both are null."""
    rest = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]
    docs = docs.select(rest)
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_probability": F.lit(None).cast("double")})
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.weights
        for b in C.batches_of(batches, 16 << 20):
            offsets, data = C.utf8_column(b.column(at))
            view, edges = memoryview(data), offsets.tolist()
            over = model.over(np.array([float(w[all_features(bytes(view[s:e]), bits)].sum(dtype=np.float64)) for s, e in zip(edges[:-1], edges[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(over.sum(axis=1)), pa.array(over[:, -1])], names=[*rest, "expected_grade", "tail_probability"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.mapInArrow(run, f"{fields}expected_grade double, tail_probability double")


def grades_of(labels: DataFrame) -> DataFrame:
    """labels with grade: 0 for poor text, 1 for good text that is toxic, 2 for good text that isn't. Null where a label is."""
    return labels.select("doc_id", F.when((F.col("quality") == 0) & F.col("toxic").isNotNull(), 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def fit_quality(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, levels: int = 3) -> OrdinalModel | None:
    """None where no labelled row has a document."""
    grades, ids, starts = sampled_features(docs, graded, "grade", sample)
    return fit_ordinal(grades.astype(np.int64), ids, starts, levels) if len(grades) else None


def quality_classifier(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, least: float = 0.6) -> DataFrame:
    """docs with expected_grade, tail_probability and kept (tail_probability is at least least, or there is no model).

    Every document is scored, labelled or not. Repeated rows get equal scores. Extra columns stay.
    """
    out = score_quality(docs.drop("kept"), fit_quality(docs, graded, sample))
    return out.withColumn("kept", F.coalesce(F.col("tail_probability") >= least, F.lit(True)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, expected_grade, tail_probability, kept."""
    out = quality_classifier(C.table(spark, sf_dir, "documents").select("doc_id", "text"), grades_of(C.table(spark, sf_dir, "labels")))
    return out.select("doc_id", "expected_grade", "tail_probability", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return quality_classifier(docs, grades_of(C.table(spark, sf_dir, "labels"))).filter("kept").select(docs.columns)
