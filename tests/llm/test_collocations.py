"""Phrases against counts by plain loops."""

import collections
import random
import re

import pytest

from plinth.llm import collocations as P

SCHEMA = "doc_id long, text string, lang string, words int, phrase string"


def pieces(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counts(rows)
    out = []
    for lang in n:
        own = {p: a for (x, p), a in f.items() if x == lang and a >= least and len(p) > 1}
        kept = []
        for p, a in own.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def sample():
    rng = random.Random(8)
    words = ["a", "A", "bb", "É", "é", "c\x1f", "the", "of", "\x00x", "long" * 20]
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", " \t ", "!?", "\x0b", ";:"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "fr", "", None]), 4, "p") for i in range(150)]
    return [*rows, rows[0], rows[0], (None, None, None, None, None), (7, "", "de", 1, ""), (8, " \n. ", "fr", 1, ""), (9, "a a " * 3000, "en", 1, "x")]


@pytest.mark.parametrize(("least", "top", "shard"), [(5, 2000, 1 << 20), (20, 7, 1500), (2, 2000, 4000)])
def test_against_loops(spark, monkeypatch, least, top, shard):
    monkeypatch.setattr(P.phrase_counts, "__defaults__", (5, least, P.MOST_CELLS, shard))
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = P.collocations(df, least=least, top=top)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_thresholds_above_a_byte(spark):
    rows = [(i, "x y " * 30, "en", 1, "") for i in range(10)]
    got = {r["phrase"]: r["a"] for r in P.collocations(spark.createDataFrame(rows, SCHEMA), least=280).collect()}
    assert got == {p: a for p, a in got.items()} and set(got) == {x[2] for x in brute(rows, 280, 2000)}


def test_few_cells_change_nothing(spark):
    texts = spark.createDataFrame([(r[2] or "und", r[1] or "") for r in sample()], "lang string, text string")
    few, many = (sorted(map(tuple, P.phrase_counts(texts, least=5, most_cells=c).collect())) for c in (1 << 16, 1 << 20))
    assert few == many


def test_bounds_and_scan():
    shard = P.Shard("en", [b"A b, a  b a\tb", b"a b"])
    assert shard.text == b" a b \n a b a b \n a b "
    assert P.scan(shard, [b" a b ", b" b a b ", b" a b a ", b" b a "]).tolist() == [4, 1, 1, 1]
    everything = P.candidates(shard, 16, P.np.full(1 << 13, 255, P.np.uint8), 5)
    assert sorted(everything) == [b" a b ", b" a b a ", b" a b a b ", b" b a ", b" b a b "]
    assert P.Shard("en", []).words == [] and P.candidates(P.Shard("en", [b"", b"."]), 16, P.np.zeros(1 << 13, P.np.uint8), 5) == []


def test_empty(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_numbers(spark, monkeypatch):
    big = 4 * 10**12
    known = [("en", 0, "", big), ("en", 1, "a", big // 3), ("en", 1, "b", big // 2), ("en", 2, "a b", big // 4)]
    monkeypatch.setattr(P, "phrase_counts", lambda texts, *a: spark.createDataFrame(known, "lang string, words int, phrase string, f long"))
    row = P.collocations(spark.createDataFrame([], SCHEMA)).first()
    assert row["score"] == 1000 * (big // 4) * big // ((big // 3) * (big // 2))
