"""Quality rules: base counts of a text, then robust multivariate outliers per language and source.

Each text's counts are transformed to a vector. For each group a minimum-covariance-determinant estimate is found as in
FAST-MCD. Several starts, the moments of all and of small random subsets, go by concentration steps over a bounded sample of
the group; those of the least determinants go on over all its rows until no determinant falls any more, and the least one
is taken. A step over all rows runs for all groups at once: distances, the core (the CORE share of the group's rows at the
smallest distances, from counts by bins that are merged map-side), then the core's moments. So a group of any size is
aggregated, never gathered; only starts come from samples. Groups under LEAST rows are pooled by language, and then all together.

The core's rows in the last bin, which spans a factor of 2 ** (1 / FINE) in squared distance, count with the weight that makes
the core's size exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Rows that a group needs for an estimate of its own: twice its dimensions and one.
LEAST = 15
#: Share of a group that its core is. Up to the rest of it may be anything.
CORE = 0.65
#: Bins of squared distances in a factor of two.
FINE = 64
#: Starts by group over samples of about START_ROWS rows: each takes two steps, the best PROMISING go on to their end, and FINALISTS over all rows, STEPS at most.
STARTS, START_ROWS, PROMISING, FINALISTS, STEPS = 200, 500, 10, 2, 12
#: Share of a group's clean rows that the cutoff rejects.
ALPHA = 0.005
#: Added to the variance of each statistic, and so part of the determinant: those that are constant in most clean text have no variance, and short texts scatter more than the core.
FLOOR = (1e-2, 4e-4, 4e-4, 4e-4, 4e-3, 2e-2, 1e-2)
#: Tables with so many pools at most (of 600 bytes) are broadcast; larger ones are joined by salted keys.
BROADCAST_POOLS, SALTS = 20_000, 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "n_lines", "n_marks")
_UPPER = bytes(range(65, 91))
_MARKS = b".,;:!?-\"'()[]{}/\\_=+~^`@"


def repeat_words(words: list[bytes], window: int = 5) -> tuple[int, int]:
    """(words in windows that occur twice or more, distinct words)."""
    known: dict[bytes, int] = {}
    add = known.setdefault
    ids = np.array([add(w, len(known)) for w in words], np.uint64)
    n = len(ids) - window + 1
    if n < 2 or len(known) == len(words):
        return 0, len(known)
    base = len(known) + 1
    if base**window < 1 << 64:
        keys = ids[:n].copy()
        for k in range(1, window):
            keys = keys * np.uint64(base) + ids[k : k + n]
    else:  # names of pairs, then of pairs of pairs, so that keys stay exact
        _, two = np.unique(ids[:-1] * np.uint64(base) + ids[1:], return_inverse=True)
        _, four = np.unique(two[:-2].astype(np.uint64) * np.uint64(two.max() + 1) + two[2:].astype(np.uint64), return_inverse=True)
        keys = four[:n].astype(np.uint64) * np.uint64(base) + ids[window - 1 :]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0, len(known)
    again = np.zeros(len(ids) + 1, np.int64)
    hit = np.unique(np.r_[order[1:][same], order[:-1][same]])
    np.add.at(again, hit, 1)
    np.subtract.at(again, hit + window, 1)
    return int((np.cumsum(again[:-1]) > 0).sum()), len(known)


def text_counts(data: bytes) -> tuple[int, ...]:
    """COUNTS of a UTF-8 text."""
    words = data.split()
    dense = data.translate(None, SPACES)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated, distinct = repeat_words(words)
    code_points = len(dense) if dense.isascii() else len(dense.decode("utf-8", "replace"))
    gone = len(dense)
    return (len(words), code_points, gone - len(dense.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, gone - len(dense.translate(None, _UPPER)), distinct, len(lines), gone - len(dense.translate(None, _MARKS)))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with COUNTS (long). Null texts are empty."""
    rest = [c for c in docs.columns if c not in (text_col, *COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = C.utf8_column(b.column(b.schema.get_field_index(text_col)))
            view, at = memoryview(data), offsets.tolist()
            rows = np.array([text_counts(bytes(view[s:e])) for s, e in zip(at[:-1], at[1:], strict=True)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*rest, *COUNTS])

    schema = T.StructType([docs.schema[c] for c in rest])
    for c in COUNTS:
        schema = schema.add(c, "long")
    return docs.select(*rest, text_col).mapInArrow(run, schema)


def statistics() -> dict[str, Column]:
    """The transformed vector: shares, and logarithms where texts differ by a factor. Shares that are zero in most texts stay near it for a few hits."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x0": F.log(chars / words),
        "x1": F.col("n_symbols") / chars,
        "x2": F.col("n_upper") / chars,
        "x3": F.col("n_marks") / chars,
        "x4": F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / words) / F.log(words + F.lit(2.0)),
        "x5": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x6": F.col("n_repeat_words") / words,
    }


NAMES = tuple(f"x{i}" for i in range(7))
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]


ESTIMATES = "pool long, start int, mean array<double>, inverse array<double>, logdet double"


def _estimate(n: float, s: np.ndarray, ss: np.ndarray, floor: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, inverse, logarithm of the determinant) from weighted sums; the inverse covariance as its upper triangle, those off the diagonal doubled."""
    m = s / n
    cov = np.zeros((len(m), len(m)))
    for v, (i, j) in zip(ss, _PAIRS, strict=True):
        cov[i, j] = cov[j, i] = v / n - m[i] * m[j]
    cov[np.diag_indices(len(m))] = np.maximum(np.diag(cov), 0) + floor
    inv = np.linalg.inv(cov)
    return m, np.array([inv[i, j] * (1 if i == j else 2) for i, j in _PAIRS]), float(np.linalg.slogdet(cov)[1])


def _sums(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    cross = x.T @ x
    return float(len(x)), x.sum(axis=0), np.array([cross[i, j] for i, j in _PAIRS])


def _distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    off = x - mean
    upper = np.zeros((len(mean), len(mean)))
    upper[tuple(zip(*_PAIRS, strict=True))] = inverse
    return ((off @ upper) * off).sum(axis=1)


def start_estimates(x: np.ndarray, core: float, floor: tuple[float, ...], starts: int = STARTS, promising: int = PROMISING, finalists: int = FINALISTS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The finalists: the estimates of the least determinants that concentration steps over x reach from its own moments and those of random subsets."""
    h, rng = max(1, math.ceil(core * len(x))), np.random.default_rng(7)

    def steps(e: tuple[np.ndarray, np.ndarray, float], most: int) -> tuple[np.ndarray, np.ndarray, float]:
        for step in range(most):  # the determinant of a start is that of other rows
            after = _estimate(*_sums(x[np.argpartition(_distances(x, *e[:2]), h - 1)[:h]]), floor)
            if step and after[2] >= e[2] - 1e-9:
                break
            e = after
        return e

    first = [x] + [x[rng.choice(len(x), min(len(x), len(NAMES) + 1), replace=False)] for _ in range(starts)]
    tried = sorted((steps(_estimate(*_sums(own), floor), 2) for own in first), key=lambda e: e[2])
    found: list[tuple[np.ndarray, np.ndarray, float]] = []
    for e in sorted((steps(e, 50) for e in tried[:promising]), key=lambda e: e[2]):
        if not any(abs(e[2] - f[2]) < 1e-6 for f in found):
            found.append(e)
    return found[:finalists]


def _starts(core: float, floor: tuple[float, ...]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = start_estimates(np.stack([table.column(c).to_numpy() for c in NAMES], axis=1), core, floor)
        return pa.table({"pool": pa.array([key[0].as_py()] * len(found), pa.int64()), "start": pa.array(range(len(found)), pa.int32()), "mean": [f[0].tolist() for f in found], "inverse": [f[1].tolist() for f in found], "logdet": [f[2] for f in found]})

    return run


def _solve(floor: tuple[float, ...]):
    """Estimates of (pool, start, n, s, ss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_estimate(n, np.array(s), np.array(ss), floor) for n, s, ss in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.float64())], names=["pool", "start", "mean", "inverse", "logdet"])

    return run


def _by_pool(rows: DataFrame, table: DataFrame, few: bool, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table that has a few rows a pool: broadcast where the number of pools is few, else by salted keys, so that a pool of any size meets its row in many tasks."""
    if few:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*NAMES), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def _d2() -> Column:
    off = [F.col(x) - F.col("mean")[i] for i, x in enumerate(NAMES)]
    return F.when(F.col("mean").isNotNull(), F.greatest(sum((F.col("inverse")[k] * off[i] * off[j] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0)), F.lit(0.0)))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(1e-9)) * FINE).cast("int")


def _cores(distances: DataFrame, share: float) -> DataFrame:
    """(pool, start, top, part): the bin in which the core, of share of the rows rounded up, ends, and the weight of its rows. A pool has some thousand bins at most."""
    bins = distances.groupBy("pool", "start", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("k"))
    pool = Window.partitionBy("pool", "start")
    upto = bins.select("pool", "start", "bin", "k", F.sum("k").over(pool.orderBy("bin")).alias("upto"), F.ceil(share * F.sum("k").over(pool)).alias("h"))
    return upto.filter("upto >= h and upto - k < h").select("pool", "start", F.col("bin").alias("top"), ((F.col("h") - F.col("upto") + F.col("k")) / F.col("k")).alias("part"))


def robust_distances(rows: DataFrame, least: int = LEAST, core: float = CORE, floor: tuple[float, ...] = FLOOR) -> DataFrame:
    """rows (NAMES, _group and _upper, the keys of a row's group and of the larger one for small groups) with d2: the squared
    Mahalanobis distance by the estimate of the least determinant, scaled so that the core ends where it does for normal rows.

    d2 is null where even all small groups together have fewer than least rows.
    """
    sizes = C.materialize(rows.groupBy("_group", "_upper").agg(F.count("*").alias("_n")), "sizes")
    small = sizes.filter(F.col("_n") < least).groupBy("_upper").agg(F.sum("_n").alias("_m"))
    pools = sizes.join(small, "_upper", "left").select("_group", "_upper", "_n", F.when(F.col("_n") >= least, F.col("_group")).when(F.col("_m") >= least, F.col("_upper")).otherwise(F.lit(0)).alias("pool"))
    pools = C.materialize(pools, "pools")
    counts = C.materialize(pools.groupBy("pool").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= least), "counts-by-pool")
    few = pools.count() <= BROADCAST_POOLS
    rows = C.materialize(_by_pool(rows, pools.select("_group", "_upper", "pool"), few, ["_group", "_upper"]).drop("_group", "_upper"), "statistics")
    # A row is in its pool's sample by chance, so a sample is of about START_ROWS rows in a pool of any size.
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    sampled = _by_pool(rows.select("pool", *NAMES), counts, few, ["pool"]).filter(chance < (START_ROWS + 2.0 * least) / F.col("_n"))
    estimates = C.materialize(sampled.select("pool", *NAMES).groupBy("pool").applyInArrow(_starts(core, floor), ESTIMATES), "estimates")
    points = rows.select("pool", *NAMES)

    def core_moments(estimates: DataFrame) -> DataFrame:
        distances = _by_pool(points, estimates, few, ["pool"]).withColumn("d2", _d2()).drop("mean", "inverse", "logdet")
        inner = _by_pool(distances, _cores(distances, core), few, ["pool", "start"]).withColumn("_w", F.when(_bin(F.col("d2")) < F.col("top"), 1.0).when(_bin(F.col("d2")) == F.col("top"), F.col("part")).otherwise(0.0)).filter("_w > 0")
        return inner.groupBy("pool", "start").agg(F.sum("_w").alias("n"), F.array(*(F.sum(F.col("_w") * F.col(x)) for x in NAMES)).alias("s"), F.array(*(F.sum(F.col("_w") * F.col(NAMES[i]) * F.col(NAMES[j])) for i, j in _PAIRS)).alias("ss"))

    live = estimates
    done: DataFrame | None = None
    for step in range(STEPS):
        after = C.materialize(core_moments(live).mapInArrow(_solve(floor), ESTIMATES), "estimates")
        if step:
            # An estimate whose determinant no longer falls is done; the others go on.
            both = after.join(live.select("pool", "start", F.col("logdet").alias("_before")), ["pool", "start"])
            stays = C.materialize(both.withColumn("_stays", F.col("logdet") > F.col("_before") - 1e-6).drop("_before"), "estimates")
            over = stays.filter("_stays").drop("_stays")
            done = over if done is None else done.unionByName(over)
            after = stays.filter("not _stays").drop("_stays")
            if after.isEmpty():
                break
        live = after
    else:
        done = live if done is None else done.unionByName(live)
    best = done.groupBy("pool").agg(F.min(F.struct("logdet", "start", "mean", "inverse")).alias("e")).select("pool", "e.*")
    best = C.materialize(best.select("pool", F.col("start").cast("int").alias("start"), "mean", "inverse", "logdet"), "estimates")
    distances = _by_pool(rows, best, few, ["pool"], "left").withColumn("d2", _d2()).drop("mean", "inverse", "logdet")
    scale = _cores(distances.filter("d2 is not null").select("pool", "start", "d2"), core).select("pool", (F.pow(F.lit(2.0), (F.col("top") + F.col("part")) / FINE) / chi_squared(core)).alias("_at"))
    return _by_pool(distances.drop("start"), scale, few, ["pool"], "left").withColumn("d2", F.col("d2") / F.col("_at")).drop("_at", "pool")


def chi_squared(share: float, degrees: int = len(NAMES)) -> float:
    """A point of the chi-squared distribution, by Wilson and Hilferty's formula."""
    z = NormalDist().inv_cdf(share)
    return degrees * (1 - 2 / (9 * degrees) + z * (2 / (9 * degrees)) ** 0.5) ** 3


def cutoff(distances: DataFrame, core: float = CORE, alpha: float = ALPHA) -> float:
    """The distance that alpha of the clean rows exceed: chi-squared's point, or where the core's tail is heavier that of the lognormal distribution through the middle and the end of the core."""
    bins = sorted((r["bin"], r["k"]) for r in distances.filter("d2 is not null").groupBy(_bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("k")).collect())  # bounded by the range of doubles
    plain = chi_squared(1 - alpha)
    if not bins:
        return plain
    upto = np.cumsum([k for _, k in bins])
    middle, end = ((bins[int(np.searchsorted(upto, share * upto[-1]))][0] + 0.5) * math.log(2) / FINE for share in (0.5, core))
    normal = NormalDist()
    return max(plain, math.exp(min(middle + (end - middle) / normal.inv_cdf(core) * normal.inv_cdf(1 - alpha), 500.0)))


def quality_rules(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """docs without the text, with COUNTS, base_failed, d2, cutoff and kept.

    base_failed: fewer than 10 words, or over a fifth of them in five-word windows that occur twice or more. Rows that pass
    go to the robust estimate of their groups (nulls are a group) and are kept if d2 is at most cutoff, which is one for all
    groups, as distances are scaled by each group's core; where there are too few rows for any estimate they are kept and d2
    is null. Null texts are empty, and so fail. Repeated rows count each. An empty table gives an empty one. Columns of docs
    may have any name; those named like an output are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, *COUNTS, "base_failed", "d2", "cutoff", "kept")]
    key = F.xxhash64(*(F.struct(F.col(f"`{g}`")) for g in groups)) if groups else F.lit(1).cast("long")
    upper = F.xxhash64(F.lit("upper"), F.struct(F.col(f"`{groups[0]}`"))) if groups else F.lit(2).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_any")).alias("_row"), key.alias("_group"), upper.alias("_upper"), F.col(f"`{text_col}`").alias("_text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = C.materialize(with_counts(rows, "_text").withColumn("base_failed", failed).withColumns(statistics()), "counts")
    passed = C.materialize(robust_distances(counted.filter("not base_failed"), least), "distances")
    most = cutoff(passed, alpha=alpha)
    out = passed.unionByName(counted.filter("base_failed").drop("_group", "_upper").withColumn("d2", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= most, F.lit(True))
    return out.select(*(F.col(f"_row.`{c}`") for c in rest), *COUNTS, "base_failed", "d2", F.lit(most).alias("cutoff"), kept.alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2, cutoff."""
    out = quality_rules(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"), "cutoff")
