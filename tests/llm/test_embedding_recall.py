"""Links in labels whose vectors all lie close together, against brute force; edges of partitions; labels of any kind."""

import numpy as np
import pytest

from plinth.llm import embedding_dedup as E


def tight(n, cosine, pairs, near=0.985, width=64, seed=1):
    """n unit vectors with about that cosine among them, and near copies of the first pairs."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(width))
    rest = rng.standard_normal((n, width))
    rest = unit(rest - np.outer(rest @ centre, centre))
    x = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * rest
    own, away = x[:pairs], rng.standard_normal((pairs, width))
    away = unit(away - (away * own).sum(1, keepdims=True) * own)
    x[n - pairs :] = near * own + np.sqrt(1 - near**2) * away
    return x


def links(x, least=0.98):
    out = np.zeros(len(x), int)
    for s in range(0, len(x), 2000):
        met = x[s : s + 2000] @ x.T >= least
        met[np.arange(len(met)), np.arange(s, s + len(met))] = False
        out[s : s + 2000] = met.sum(1)
    return out


@pytest.mark.parametrize(("n", "cosine"), [(2500, 0.95), (12_000, 0.9), (30_000, 0.95)])
def test_recall_in_a_tight_label(spark, tmp_path, n, cosine):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = tight(n, cosine, n // 10)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x)), "label": np.zeros(n, int)}), f"{tmp_path}/v.parquet", row_group_size=4000)
    got = np.array([r["n_links"] for r in E.embedding_links(spark.read.parquet(f"file://{tmp_path}/v.parquet")).orderBy("vec_id").collect()])
    want = links(x)
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum(), got.sum() / want.sum()


def points_of(spark, rows):
    return spark.createDataFrame(rows, "node long, label long, width int, v array<double>")


def test_neighbours_behind_an_edge_meet(spark, monkeypatch):
    """One pass, whose order puts near copies side by side, over as many partitions as there may be."""
    x = tight(400, 0.2, 0)
    x = np.repeat(x, 2, axis=0) + 1e-4 * np.random.default_rng(2).standard_normal((800, 64))
    rows = [(i, 0, 64, v.tolist()) for i, v in enumerate(x)]
    found = {}
    for parts in (1, 5, 40):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = E.joined(points_of(spark, rows), 0.98, rounds=((1, 8),), recall=0.0).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        found[parts] = sorted(map(tuple, got))
    assert found[1] == found[5] == found[40] and len(found[1]) > 700


def test_labels_that_passes_cannot_do_are_compared_whole(spark):
    x = tight(700, 0.97, 70)
    rows = [(i, 3, 64, v.tolist()) for i, v in enumerate(x)]
    got = {r["node"] for r in E.joined(points_of(spark, rows), 0.98, rounds=((1, 1),)).collect()}
    assert got == set(np.flatnonzero(links(x)).tolist())


@pytest.mark.parametrize(("kind", "labels"), [("string", ["a", "a", "b", None]), ("double", [1.2, 1.2, 1.7, None]), ("int", [1, 1, 2, None])])
def test_labels_of_any_kind(spark, kind, labels):
    rows = [(f"v{i}", [1.0, 0.0, 0.01 * i], x) for i, x in enumerate(labels)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_links(spark.createDataFrame(rows, f"vec_id string, embedding array<double>, label {kind}")).collect()}
    assert got == {"v0": (1, "v0", True), "v1": (1, "v0", False), "v2": (0, "v2", True), "v3": (0, "v3", True)}
