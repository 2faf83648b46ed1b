"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plinth.llm import embedding_dedup, lm, packing, quality_rules, sais, simhash, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ab", "É", "zeta", "eta", "iota"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = words(rng, 70)
    texts = [words(rng, rng.randint(5, 160)) for _ in range(25)]
    texts += [texts[0], texts[1] + " tail", passage + " " + words(rng, 30), words(rng, 30) + "\n" + passage, None, "", " \n ", "be " * 500, "x" * 900, "é" * 450, "One two", "ONE two", words(rng, 6000)]
    out = [(i, t, "src0" if i % 3 else None, 7) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, texts[3], "s", 1), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, removed int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp string, removed int")


def test_suffix_arrays(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        monkeypatch.setattr(sais, "LEAST_RUN", rng.choice([2, 6, 1024]))
        s = rng.choice([1, 2, 3, 20])
        t = np.array([rng.randint(1, s) for _ in range(rng.randint(1, 80))] + [0], np.uint16)
        sa = sais.suffix_array(t, s + 1)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        p = sais.permuted_lcp(t, sa)
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            assert p[i] == k


def test_suffix_array_of_a_whole_shard_recurses(monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}x" for i in range(3000)]
    text = " ".join(rng.choice(vocabulary) for _ in range(suffix_dedup.SHARD // 6)).encode()[: suffix_dedup.SHARD]
    t = np.r_[np.frombuffer(text, np.uint8).astype(np.uint16) - 31, 0].astype(np.uint16)
    levels = []
    whole = sais.suffix_array

    def counted(t, sigma):
        levels.append((len(t), sigma))
        return whole(t, sigma)

    monkeypatch.setattr(sais, "suffix_array", counted)
    sa = counted(t, int(t.max()) + 1)
    assert len(levels) >= 3 and levels[1][1] > 1024  # by recursion, also over many names
    assert (np.sort(sa) == np.arange(len(t))).all()
    at = np.sort(rng.sample(range(1, len(t)), 3000))
    data = bytes(text)
    assert all(data[i:] < data[j:] for i, j in zip(sa[at - 1].tolist(), sa[at].tolist(), strict=True) if i < len(data))


def removed_by_hand(texts, n):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mask[i : i + n] = b"\1" * n
        out.append(bytes(mask))
    return out


@pytest.mark.parametrize("hot", [8192, 1])
@pytest.mark.parametrize("n", [200, 64])
def test_repeated_strings(docs, rows, hot, n):
    texts = [(r[1] or "").encode() for r in rows]
    want = collections.Counter()
    for r, t, mask in zip(rows, texts, removed_by_hand(texts, n), strict=True):
        want[(r[0], r[1], bytes(c for c, m in zip(t, mask, strict=True) if not m), sum(mask))] += 1
    got = suffix_dedup.suffix_array_dedup(docs, min_len=n, hot=hot).collect()
    assert collections.Counter((r["doc_id"], r["text"], bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["removed"])) for r in got) == want
    assert all(r["fp"] in ("src0", None, "s") for r in got)


def test_repeated_strings_in_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    texts = [(r[1] or "").encode() for r in rows]
    for _, t in enumerate(texts):
        for s, data in ((0, np.frombuffer(t[:700], np.uint8)),):
            if len(data) >= 200:
                start, count, _, _ = suffix_dedup._segments(data, 200)
                assert start[0] == s and count.sum() == len(data) - 199


def test_repeated_strings_beside_clashing_names(spark, rows):
    clashing = spark.createDataFrame([(f"k{r[0]}" if r[0] is not None else None, r[1], i, i, i, i) for i, r in enumerate(rows)], "doc_id string, text string, starts int, _id int, _th int, _row int")
    want = collections.Counter()
    for i, (r, mask) in enumerate(zip(rows, removed_by_hand([(r[1] or "").encode() for r in rows], 200), strict=True)):
        want[(f"k{r[0]}" if r[0] is not None else None, sum(mask), i, i, i, i)] += 1
    got = suffix_dedup.suffix_array_dedup(clashing)
    assert got.columns == [*clashing.columns, "removed", "kept"]
    assert collections.Counter((r["doc_id"], sum(s["end"] - s["start"] for s in r["removed"]), r["starts"], r["_id"], r["_th"], r["_row"]) for r in got.collect()) == want


def test_second_hash_tells_apart_what_the_first_confuses():
    # Strings of Thue and Morse: sums modulo a power of two of a few such bytes are equal for any base.
    def thue(n):
        return bytes(97 + (i.bit_count() & 1) for i in range(n))

    a = thue(2048)
    b = bytes(195 - x for x in a)
    seen = {}
    for text in (a, b):
        start, count, owner, seg = suffix_dedup._segments(np.frombuffer(text, np.uint8), 1024)
        for s, n, o, h in zip(start.tolist(), count.tolist(), owner.tolist(), seg.tolist(), strict=True):
            piece = text[s : s + n + 1023]
            assert seen.setdefault((o, h, n), piece) == piece


def test_kept_characters_stay_whole(docs):
    out = suffix_dedup.suffix_array_dedup(docs, characters=True)
    for r in out.collect():
        bytes(r["kept"]).decode("utf-8")


def print_by_hand(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def sets_by_hand(n, near):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("bits", "groups"), [(4, 8), (8, 10)])
def test_simhash(docs, rows, bits, groups):
    prints = [print_by_hand(r[1]) for r in rows]
    root = sets_by_hand(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= bits)
    least = {k: min((r[0] for r, x in zip(rows, root, strict=True) if x == k and r[0] is not None), default=None) for k in root}
    want = collections.Counter((r[0], p, least[k]) for r, p, k in zip(rows, prints, root, strict=True))
    got = simhash.simhash_components(docs, most_bits=bits, groups=groups).collect()
    assert collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want


def test_number_of_groups():
    assert simhash.groups_for(0) == 8 and simhash.groups_for(10**6) == 8
    assert simhash.groups_for(10**9) > 8 and simhash.groups_for(10**20) == 32


def test_stars_keep_linked_sets():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        x, y = embedding_dedup._stars(a, b)
        both = set(zip(a.tolist(), b.tolist(), strict=True))
        stars = set(zip(x.tolist(), y.tolist(), strict=True))
        assert sets_by_hand(60, lambda i, j: (i, j) in both or (j, i) in both) == sets_by_hand(60, lambda i, j: (i, j) in stars or (j, i) in stars)
        assert len(stars) <= 59


def test_simhash_large_cells():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3, np.uint64)
    points = np.unique(np.concatenate([[b ^ np.uint64(sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 5)))) for _ in range(40)] for b in base]).astype(np.uint64))
    a, b = simhash._forest(points, 4)
    at = {int(p): i for i, p in enumerate(points)}
    linked = {(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)}
    mine = sets_by_hand(len(points), lambda i, j: (i, j) in linked or (j, i) in linked)
    assert mine == sets_by_hand(len(points), lambda i, j: (int(points[i]) ^ int(points[j])).bit_count() <= 4)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(r[0], k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    got = packing.packed_documents(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048


def test_combinations_are_tight():
    rng = random.Random(4)
    for _ in range(30):
        cap = rng.choice([10, 64, 2048])
        hist = {rng.randint(1, cap): rng.randint(1, 50) for _ in range(40)}
        used = collections.Counter()
        bins = 0
        for times, chosen in packing.combinations(hist, cap):
            assert times > 0 and sum(n * k for n, k in chosen.items()) <= cap
            bins += times
            for n, k in chosen.items():
                used[n] += times * k
        assert dict(used) == hist
        assert bins <= math.ceil(sum(n * c for n, c in hist.items()) / cap * 1.25) + 2
    for _ in range(5):  # as many short pieces as texts have: within one of the bound
        hist = {rng.randint(1, 400) if rng.random() < 0.8 else rng.randint(400, 2048): rng.randint(1, 30) for _ in range(300)}
        assert sum(t for t, _ in packing.combinations(hist, 2048)) <= math.ceil(sum(n * c for n, c in hist.items()) / 2048) + 1
    assert packing.combinations({6: 2, 4: 2}, 10) == [(2, {6: 1, 4: 1})]


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for text in ("", " ", "\n\n \n", "a" * 5000, " " * 70_000, "<|endoftext|> x", "Iñtërnâtiônàl 中文   é \x00 🎉", "don't  stop\t\tnow"):
        assert list(packing.token_ids(text, packing.default_tokenizer())) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    vectors = [b + s * rng.standard_normal(16) for b in base for s in (0, 0.02, 0.05, 0.08, 0.2)]
    data = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    data += [(100, data[0][1], 0), (101, None, 0), (102, [0.0] * 16, 0), (103, [float("nan")] * 16, 0), (104, [1.0, None] * 8, 0), (105, data[0][1], None), (106, data[0][1][:8], 0), data[1], data[1], (None, data[2][1], 0), (107, [x * 1e-30 for x in data[0][1]], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)

    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def near(i, j):
        (_, a, la), (_, b, lb) = data[i], data[j]
        if la is None or la != lb or not good(a) or not good(b) or len(a) != len(b):
            return False
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98

    n = len(data)
    root = sets_by_hand(n, near)
    links = [sum(near(i, j) for j in range(n) if j != i) for i in range(n)]
    least = {k: min((data[i][0] for i in range(n) if root[i] == k and data[i][0] is not None), default=None) for k in root}
    want = collections.Counter((data[i][0], links[i], least[root[i]]) for i in range(n))
    got = embedding_dedup.embedding_links(df, block=block).collect()
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def counts_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)


def test_text_counts(rows):
    for text in [*(r[1] for r in rows), "a b a b a b a b a b", "x\n \nx\nx ", "# $ | <é>", " ".join(map(str, range(9000))) + " 1 2 3 4 5 6"]:
        assert quality_rules.text_counts((text or "").encode())[:5] == counts_by_hand(text)


def least_determinant(x, core, floor, starts=150):
    """(determinant, distances) of the least of many starts, with an exact core."""
    rng, h, best = np.random.default_rng(0), math.ceil(core * len(x)), (math.inf, None)
    for _ in range(starts):
        own = x[rng.choice(len(x), min(8, len(x)), replace=False)]
        before = math.inf
        while True:
            cov = np.cov(own.T, bias=True) + np.diag(floor)
            det = np.linalg.slogdet(cov)[1]
            d2 = np.einsum("ij,jk,ik->i", x - own.mean(axis=0), np.linalg.inv(cov), x - own.mean(axis=0))
            if det >= before - 1e-9:
                break
            before, own = det, x[np.argsort(d2, kind="stable")[:h]]
        if det < best[0]:
            best = (det, d2 / np.sort(d2)[h - 1] * quality_rules.chi_squared(core))
    return best


def test_robust_distances_against_brute_force(spark):
    """Three tenths of a group lie in a far cluster; a small group is judged by itself, smaller ones by their language."""
    rng, floor = np.random.default_rng(4), (1e-3,) * 7
    pools = []
    for n, out in ((600, 180), (2500, 750), (40, 8), (9, 0), (9, 0)):
        mix = rng.standard_normal((7, 7)) * 0.3 + np.eye(7)
        x = rng.standard_normal((n, 7)) @ mix
        x[:out] = 1.5 * rng.standard_normal((out, 7)) @ mix + 12
        pools.append((x, out))
    rows = [(g, "a" if g < 3 else "b", i, *map(float, v)) for g, (x, _) in enumerate(pools) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g long, lang string, i int, " + ", ".join(f"{c} double" for c in quality_rules.NAMES)).repartition(3)
    keyed = df.withColumns({"_group": F.xxhash64("g"), "_upper": F.xxhash64("lang")})
    got = quality_rules.robust_distances(keyed, floor=floor).collect()
    assert len(got) == len(rows)
    mine = {(r["g"], r["i"]): r["d2"] for r in got}
    for members in ((0,), (1,), (2,), (3, 4)):
        x = np.concatenate([pools[g][0] for g in members])
        want = least_determinant(x, quality_rules.CORE, floor)[1]
        have = np.array([mine[g, i] for g in members for i in range(len(pools[g][0]))])
        assert np.median(np.abs(have / want - 1)) < 0.06, members
        out = pools[members[0]][1]
        if out:
            assert have[:out].min() > quality_rules.chi_squared(0.999) and have[:out].min() > 3 * np.quantile(have[out:], 0.9)


def test_start_estimates_reach_the_least_determinant():
    rng, floor = np.random.default_rng(9), (1e-3,) * 7
    x = rng.standard_normal((300, 7))
    x[:100] = 8 + rng.standard_normal((100, 7))
    best = quality_rules.start_estimates(x, quality_rules.CORE, floor)
    assert best[0][2] <= least_determinant(x, quality_rules.CORE, floor)[0] + 0.02
    assert all(a[2] <= b[2] for a, b in zip(best, best[1:], strict=False))


def test_quality_rules(spark, docs, rows, empty):
    groups = ("fp",)
    got = quality_rules.quality_rules(docs, groups=groups).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["kept"] is not None and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty, groups=groups).count() == 0
    rng = random.Random(8)
    clean = [(i, " ".join(rng.choice("of the cat sat mat dog ran far hill tree".split()) + rng.choice("abcdefgh") for _ in range(120)) + ".", "en", i, i, i, i) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "###" for w in clean[i][1].split()), "en", i, i, i, i) for i in range(10)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, pool int, mean int, x0 int, _row int")
    out = quality_rules.quality_rules(df, groups=("lang",))
    assert out.columns[:6] == ["doc_id", "lang", "pool", "mean", "x0", "_row"]
    found = out.collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(r["pool"] == r["mean"] == r["x0"] == r["_row"] == r["doc_id"] % 1000 for r in found)
    assert not any(kept[i] for i in range(1000, 1010)) and sum(kept[i] for i in range(300)) >= 294
    few = quality_rules.quality_rules(df.limit(5), groups=("lang",)).collect()
    assert all(r["d2"] is None and r["kept"] for r in few)


def test_language_model_counts(spark, docs, rows, empty):
    got = lm.score_texts(docs).collect()
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in rows]
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(t for ts, o in zip(tokens, out, strict=True) if not o for t in ts)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], o, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts, o in zip(rows, tokens, out, strict=True))
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm.score_texts(empty).count() == 0
    named = lm.score_texts(docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("word"), F.lit(2).alias("part"))).collect()
    assert {r["doc_id"] for r in named if r["doc_id"]} == {f"k{r[0]}" for r in rows if r[0] is not None}


def test_word_counts_over_blocks_and_buckets(docs, monkeypatch):
    """Small blocks and split buckets: counts depend on neither."""

    def counts():
        return sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in lm.score_texts(docs, rates=(0.6,)).collect())

    want = counts()
    monkeypatch.setattr(lm, "BLOCK", 300)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 40)
    assert counts() == want


def small_model(rng, words=300, n=4000):
    codes = np.minimum(rng.zipf(1.3, n), words) - 1
    lengths = np.full(n // 40, 40)
    count, steps, marks = np.bincount(codes, minlength=words), rng.integers(0, 256, words), rng.integers(0, 65536, words)
    bins = [min(i, lm.BINS - 1) for i in range(20)]
    vocabulary = lm.Vocabulary(n, words, len(lengths), bins, np.zeros(lm.WAYS**3), *lm._shares(np.zeros(lm.WAYS**3)))
    cells = vocabulary.ways(count, steps, marks)
    vocabulary.mass = np.bincount(cells, count, minlength=lm.WAYS**3)
    mass = vocabulary.mass + 0.0
    mass[lm.NEW * lm.WAYS**2], mass[lm.END * lm.WAYS**2] = 5, len(lengths)
    vocabulary.first, vocabulary.second, vocabulary.third = lm._shares(mass)
    return vocabulary, lengths, codes, count, cells, marks


def test_language_model_gradient():
    """Seen less expected is the slope of the log likelihood by each weight, against differences."""
    rng = np.random.default_rng(1)
    vocabulary, lengths, codes, _, cells, marks = small_model(rng)
    own, last, before, _, _ = lm._token_arrays(lengths, codes, cells, marks)
    weights = (0.1 * rng.standard_normal((lm.ROWS, lm.WAYS))).astype(np.float32)
    slope, seen = np.zeros((lm.ROWS, lm.WAYS)), np.zeros((lm.ROWS, lm.WAYS))
    lm.add_slope(vocabulary, weights, own, last, before, slope)
    lm.add_seen(own, last, before, seen)
    assert seen.sum() == len(lm.KINDS) * len(own) and (seen >= slope - 1e-3).all()
    for f in range(len(lm.KINDS)):
        part = np.abs(slope[lm._BASES[f] : lm._BASES[f + 1]])
        row, way = np.unravel_index(int(part.argmax()), part.shape)
        value = []
        for step in (0.02, -0.02):
            moved = weights.copy()
            moved[lm._BASES[f] + row, way] += step
            value.append(lm.add_slope(vocabulary, moved, own, last, before, np.zeros_like(slope)))
        got, want = slope[lm._BASES[f] + row, way], (value[0] - value[1]) / 0.04
        assert abs(got - want) <= 0.02 * abs(want) + 0.05, lm.KINDS[f]


def test_language_model_adds_up():
    """Over all words, a new one and the end, probabilities after any history sum to one."""
    rng = np.random.default_rng(2)
    vocabulary, _, _, count, cells, marks = small_model(rng)
    weights = (0.5 * rng.standard_normal((lm.ROWS, lm.WAYS))).astype(np.float32)
    outcomes = np.r_[cells[count > 0], lm.NEW * lm.WAYS**2, lm.END * lm.WAYS**2]
    within = np.r_[count[count > 0] / vocabulary.mass[cells[count > 0]], 1, 1]
    history = [(cells[3], marks[3]), (cells[9], marks[9])]
    total = 0.0
    for cell, share in zip(outcomes, within, strict=True):
        own = np.array([history[0][0], history[1][0], cell])
        features = lm.history_features(np.array([0, history[0][1] + 1, history[1][1] + 1]), np.array([0, 0, history[0][1] + 1]), own)
        p = 1.0
        for _, x, way in lm._choices(vocabulary, weights, features, own, slice(2, 3)):
            p *= x[0, way[0]]
        total += p * share
    assert abs(total - 1) < 1e-3


def test_language_model_learns_the_order_of_words(spark):
    """Texts whose words are permuted, and so have the same counts, score worse; held-out ones score better than by counts alone."""
    rng = random.Random(3)
    after = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(4)] for i in range(200)}
    texts = []
    for _ in range(700):
        words_ = [f"w{rng.randrange(200)}"]
        while len(words_) < 60:
            words_.append(rng.choice(after[words_[-1]]))
        texts.append(words_)
    shuffled = [rng.sample(t, len(t)) for t in texts]
    rows_ = [(i, " ".join(t)) for i, t in enumerate(texts)]
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 7 == 2]
    spare = [i for i in range(700, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(held)]
    rows_ += [(j, " ".join(shuffled[i])) for i, j in zip(held, spare, strict=True)]
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()}
    own, mixed = sum(got[i]["score"] for i in held), sum(got[j]["score"] for j in spare)
    assert own > mixed + 0.1 * 61 * len(held)
    assert own > sum(got[i]["base_score"] for i in held) + 0.2 * 61 * len(held)


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, None), (3, "http://a b", ""), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "u", "é\r\n\r\n"), (8, "u", "é\r\n\r\n"), (None, "u", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (11, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, html in rows:
        key = html or ""
        if i is not None:
            first[key] = min(first.get(key, i), i)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    got = warc.resolve_payloads(warc.read_archives(spark, path), payload=True).collect()
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        own = first[html or ""]
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own == i else "revisit", None if own == i else own, data)] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got) == want
    data = b"".join(p.read_bytes() for p in tmp_path.glob("warc/*.warc.gz"))
    ids, at = [], 0
    while at < len(data):  # one gzip member a record
        reader = zlib.decompressobj(31)
        record = reader.decompress(data[at:])
        assert reader.eof and record.startswith(b"WARC/1.1") and len(list(warc.parse_archive(record))) == 1
        ids.append(re.search(rb"WARC-Record-ID: (.*)", record)[1])
        at = len(data) - len(reader.unused_data)
    assert len(ids) == len(set(ids)) and len(ids) == len(rows) + len(list(tmp_path.glob("warc/*.warc.gz")))
    named = pages.select("page_id", "html", F.col("url"), F.lit(1).alias("first"), F.lit(2).alias("digest"), F.lit(3).alias("id"))
    warc.write_archives(named, path + "1")
    assert warc.read_archives(spark, path + "1").count() == len(rows)
    warc.write_archives(pages.limit(0), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0


def test_large_records_end_with_a_zero():
    big = warc.member([("WARC-Type", "response")], bytes(17 << 20)) + b"\0"
    import gzip

    small = [warc.member([], str(i).encode()) + b"\0" for i in range(50)]
    assert [m.split(b"\r\n\r\n")[1] for m in warc.members(b"".join(small), 7)] == [str(i).encode() for i in range(50)]
    with pytest.raises(ValueError):
        list(warc.members(small[0][:-3]))
    assert gzip.decompress(big + big).count(b"WARC/1.1") == 2 and gzip.decompress(warc.member([], b"x") + b"\0").endswith(b"x\r\n\r\n")


def test_empty_tables(empty):
    assert suffix_dedup.suffix_array_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert packing.packed_documents(empty).count() == 0


def test_similar_texts(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = words(rng, 120).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", " \n", "a b", "A  B", words(rng, 3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, texts[3])], "doc_id long, text string").repartition(3)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]

    def near(i, j):
        return len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    root = sets_by_hand(len(texts), near)
    found = {r["node"]: r["component"] for r in simhash.similar_components(docs).collect()}
    equal = {}
    for i, s in enumerate(sets):
        equal.setdefault(frozenset(s), i)
    mine = [found.get(equal[frozenset(s)], equal[frozenset(s)]) for s in sets]
    wrong = [i for i in range(len(texts)) if mine[i] != root[i]]
    assert all(root[mine[i]] == root[i] for i in range(len(texts)))  # no link below the similarity
    assert len(wrong) <= 0.05 * len(texts)
    kept = [r["doc_id"] for r in simhash.near_dedup_stage(spark, docs, "").select("doc_id").collect()]
    named = [i for i in kept if i is not None]
    assert len(kept) == len(named) + 1 and len(named) == len(set(named)) and 0 in named
    assert 30 <= len(named) <= len(set(root)) + len(wrong)  # links by bits may join more
    assert simhash.similar_components(docs.limit(0)).count() == 0
