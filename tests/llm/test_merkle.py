"""Hash trees against a plain walk over lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plinth.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, n string, key string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes, fanout=3):
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for s in range(0, len(nodes), fanout):
            run = nodes[s : s + fanout]
            for j in range(len(run)):
                for i in members[s + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            above.append(h(*run))
            held.append(sum(members[s : s + fanout], []))
        nodes, members = above, held
    return nodes[0], paths


def brute(rows):
    trees = []
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, top = climb([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), over in zip(trees, top, strict=True):
        for r, p in zip(own, paths, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf([*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]])
            for left, right in p + over:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf(r), subroot, root, h(*(x for left, right in p + over for x in left + right)), folded, folded == root))
    return sorted(out, key=str)


def sample(n, sources, seed):
    rng = random.Random(seed)
    text = ["", None, "a\nb", "é\n\n", "plain", "\n", "x" * 50_000 + "\n"]
    return [(None if i == 3 else rng.randint(0, n), rng.choice(sources), rng.choice(["en", "", None]), rng.choice([None, 0, 7]), rng.choice(text), 9, "n", "k") for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(0, [None]), (1, [None]), (1, ["s"]), (2, ["a", None]), (40, ["a", "é", "", None, "B"]), (85, ["one"]), (120, ["hot"] * 6 + [f"s{i}" for i in range(30)])])
def test_against_lists(spark, n, sources):
    rows = sample(n, sources, n)
    rows += rows[:2]  # rows that repeat
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = M.tamper_check(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert all(r["verified"] is not None for r in got)


def test_other_fanout_names_and_kinds(spark):
    rows = [(f"id{i:03d}", i % 2, f"t{i}") for i in range(30)]
    manifest = M.build(spark.createDataFrame(rows, "name string, part int, body string"), "name", "part", ["name", "body"], fanout=4)
    assert {(r["kind"], r["level"]): r["n"] for r in manifest.nodes().groupBy("kind", "level").agg(F.count("*").alias("n")).collect()} == {("group", 0): 30, ("group", 1): 8, ("group", 2): 2, ("top", 0): 2, ("top", 1): 1}
    own = [[h(*(f"{len(v)}:{v}" for v in (f"id{i:03d}", f"t{i}"))) for i in range(p, 30, 2)] for p in (0, 1)]
    assert manifest.root == climb([climb(x, 4)[0] for x in own], 4)[0]
    proved = manifest.proofs().select(M.fold(F.col("digest"), F.col("path")).alias("root")).distinct().collect()
    assert [r["root"] for r in proved] == [manifest.root]


def test_any_change_shows(spark):
    rows = [(i, "s", "en", 3, f"text {i}") for i in range(20)]
    root = M.build(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).root
    for change in ((5, "s", "en", 3, "text 5 "), (5, "s", None, 3, "text 5"), (5, "t", "en", 3, "text 5")):
        other = [*rows[:5], change, *rows[6:]]
        assert M.build(spark.createDataFrame(other, "doc_id long, source string, lang string, n_chars long, text string")).root != root
