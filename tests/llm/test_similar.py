"""Links by shingle sets lose no pair."""

import random

from plinth.llm import simhash


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.random()}"
    return words


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string").repartition(4)
    return {r["node"]: r["component"] for r in simhash.similar_components(docs).collect()}


def test_pairs_inside_a_template_family(spark):
    """Texts of one template, 0.6 to 0.75 from one another, each with a near copy."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(300)]
    own = [edited(rng, template, 6) for _ in range(400)]
    copies = [edited(rng, t, 3) for t in own]
    assert all(similarity(a, b) >= 0.8 for a, b in zip(own, copies, strict=True))
    got = found(spark, own + copies)
    lost = [i for i in range(400) if i not in got or got[i] != got.get(i + 400)]
    assert not lost


def test_equal_sets_of_other_counts(spark):
    """Texts that repeat the same passages in other numbers have equal sets; each has its row, and one of them stays."""
    rng = random.Random(5)
    texts = []
    for i in range(20):
        p, q = ([f"w{i}-{rng.random()}" for _ in range(rng.randrange(30, 120))] for _ in range(2))
        texts += [p * 3 + q * 2, p * 2 + q * 3]
    got = found(spark, texts)
    assert got == {i: i - i % 2 for i in range(40)}
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup_stage(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_all_copies_of_similar_texts(spark):
    """Each copy is linked, not only the one with the smallest id."""
    rng = random.Random(8)
    a = [f"a{i}" for i in range(100)]
    b = edited(rng, a, 2)
    assert found(spark, [a, b, a, b, a]) == dict.fromkeys(range(5), 0)


def test_pairs_just_over_the_similarity(spark):
    """Pairs at 0.8 to 0.85, of short and long texts, are all linked, and pairs just below aren't."""
    rng = random.Random(11)
    texts, over, under = [], [], []
    while len(over) < 300 or len(under) < 100:
        a = [f"w{rng.random()}" for _ in range(rng.choice((12, 40, 150, 400)))]
        b = edited(rng, a, rng.randrange(1, max(2, len(a) // 30)))
        if 0.8 <= (s := similarity(a, b)) <= 0.85 and len(over) < 300:
            over.append(len(texts))
        elif 0.7 <= s < 0.8 and len(under) < 100:
            under.append(len(texts))
        else:
            continue
        texts += [a, b]
    got = found(spark, texts)
    assert got == {j: i for i in over for j in (i, i + 1)}


def test_no_text_is_lost(spark):
    """Rows that share an id but not the text stay each; rows that repeat are one; of copies the smallest id stays; rows without an id stay."""
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.random()}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, c), (3, a), (4, None), (5, ""), (0, d + " end"), (9, d), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (2, c), (4, None), (0, d + " end"), (None, a), (None, a)], key=str)


def test_text_ids(spark):
    rng = random.Random(13)
    a, b = (" ".join(f"w{rng.random()}" for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([("x", a), ("y", a + " tail"), ("z", b), ("a", b)], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup_stage(spark, docs, "").collect()) == ["a", "x"]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert got["z"] == got["a"] == "a"
