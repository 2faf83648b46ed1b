"""Trained operators by held-out accuracy, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import language_id, mixing, quality_classifier

EN = "the of and to in is that for it with as was on be by at this have from or".split()
FR = "le la les de des et un une est que pour dans qui sur pas avec ce il au par".split()


def text(rng, base, n=60):
    return " ".join(rng.choice(base) if rng.random() < 0.6 else rng.choice(base) + rng.choice(base) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang, base = ("en", EN) if i % 3 else ("fr", FR)
        t = text(rng, base)
        quality, toxic = 1, 0
        if i % 10 == 7:
            t, toxic = t + " vileword" + rng.choice("abc"), 1
        if i % 10 == 3:
            t, quality = " ".join(w.upper() + "!!!" for w in t.split()), 0
        rows.append((i, t, lang, "s", quality, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int, toxic int")
    return df.select("doc_id", "text", "lang", "source"), df.select("doc_id", "quality", "toxic")


def odd(spark, docs):
    extra = spark.createDataFrame([(1000, None, None, None), (1001, "", "en", "s"), (None, "the of", None, "s"), (1002, "the " * 30_000, "en", "s"), (1, "the of", "fr", "s")], docs.schema)
    return docs.unionByName(extra)


def test_quality_classifier(spark, corpus):
    docs, labels = corpus
    train = quality_classifier.grades_of(labels.filter("doc_id < 250"))
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier(docs, train).collect()}
    held = [i for i in range(250, 400)]
    right = sum(got[i]["kept"] == (i % 10 not in (3, 7)) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["expected_grade"] <= 2 for r in got.values())
    assert quality_classifier.quality_classifier(odd(spark, docs), train).count() == 405
    bare = quality_classifier.quality_classifier(docs, train.limit(0))
    assert bare.filter("kept").count() == 400 and bare.filter("tail_probability is null").count() == 400
    assert quality_classifier.quality_classifier(docs.limit(0), train).count() == 0


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1000, 5000)
    model = quality_classifier.fit_ordinal(rng.integers(0, 3, 500), ids, np.arange(0, 5001, 10), 3, rounds=30)
    assert (np.diff(model.thresholds) >= 0).all()
    over = model.over(np.array([-5.0, 0.0, 5.0]))
    assert (over[:, 0] >= over[:, 1]).all() and (np.diff(over, axis=0) >= 0).all()


def test_ordinal_slopes_against_differences():
    rng = np.random.default_rng(5)
    score, cuts, grades, weight = rng.normal(0, 2, 50), np.array([-0.7, 1.1]), rng.integers(0, 3, 50), rng.random(50)
    slope, by_cut, _ = quality_classifier.ordinal_slopes(score, cuts, grades, weight)

    def value(s, c):
        return quality_classifier.ordinal_slopes(s, c, grades, weight)[2]

    for i in range(50):
        step = np.eye(1, 50, i)[0] * 1e-5
        assert abs((value(score + step, cuts) - value(score - step, cuts)) / 2e-5 - slope[i]) < 1e-5
    for k in range(2):
        step = np.eye(1, 2, k)[0] * 1e-5
        assert abs((value(score, cuts + step) - value(score, cuts - step)) / 2e-5 + by_cut[k]) < 1e-5


def test_language_id_against_a_plain_sum(spark, corpus):
    """The posterior by loops over rows: text, host within site within all, declaration and suffix, each without the row itself."""
    docs, _ = corpus
    model = language_id.fit_text_model(docs)
    rng = random.Random(13)
    rows = []
    for i in range(40):
        lang, base = ("en", EN) if rng.random() < 0.6 else ("fr", FR)
        declared = rng.choice([lang, "", "de"])
        tag = f"<html lang='{declared}'>" if declared else "<html>"
        rows.append((i, rng.choice([f"https://h{i % 3}.site.org/{lang}/x", "http://solo.fr/", None]), f"{tag}<p>{text(rng, base, rng.choice((0, 6, 30)))}</p>"))
    got = {r["page_id"]: r["posterior"] for r in language_id.identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    ready = language_id.evidence_columns(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html")
    facts = {r["page_id"]: (r["_host"], r["_site"], r["_declared"], r["_suffix"]) for r in ready.collect()}
    score = {i: model.scores(language_id.visible_text(h.encode())) for i, _, h in rows}
    p = {i: np.exp(s - s.max()) / np.exp(s - s.max()).sum() for i, s in score.items()}
    n, shrink = len(rows), language_id.SHRINK
    prior = (sum(p.values()) + 1) / (n + 2)
    for i, *_ in rows:
        host, site, *said = facts[i]
        others = [j for j, *_ in rows if j != i]
        near = [p[j] for j in others if facts[j][1] == site]
        own = [p[j] for j in others if facts[j][0] == host]
        by_site = (sum(near, np.zeros(2)) + shrink * prior) / (len(near) + shrink)
        total = np.log((sum(own, np.zeros(2)) + shrink * by_site) / (len(own) + shrink)) + score[i]
        for at, value in zip((2, 3), said, strict=True):
            same = [p[j] for j in others if facts[j][at] == value]
            if value not in ("", ".") and same:
                share = len(same) / n
                total = total + np.log((sum(same) + shrink * share * prior) / (n * prior + shrink * prior)) - np.log(share)
        want = np.exp(total - total.max())
        assert np.allclose(got[i], want / want.sum(), atol=1e-6), i


def test_language_id(spark, corpus):
    docs, _ = corpus
    model = language_id.fit_text_model(docs)
    assert model.languages == ["en", "fr"]
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(120):
        lang, base = ("en", EN) if i % 2 else ("fr", FR)
        shown = f"<html lang='{lang}'><head><title>t</title></head><body>{text(rng, base, 40) if i % 10 else ''}</body></html>"
        rows.append((i, f"https://{lang}{i % 4}.site.com/{lang}/{i}", shown))
        want[i] = lang
    rows += [(200, None, None), (201, "", ""), (None, "no address", "<p>the of and</p>"), (0, rows[0][1], rows[0][2]), (202, "http://en1.site.com/x", "<p>" + "the of and to " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language_id.identify_languages(pages, model).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert sum(by[i]["lang"] == want[i] for i in want) >= 0.98 * len(want)
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    assert by[200]["probability"] < 0.9 and by[202]["lang"] == "en"
    assert language_id.identify_languages(pages.limit(0), model).count() == 0
    none = language_id.identify_languages(pages, language_id.fit_text_model(docs.limit(0))).collect()
    assert len(none) == len(rows) and all(r["lang"] is None for r in none)


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing(spark, corpus, least):
    docs, labels = corpus
    model = mixing.fit_domains(docs, mixing.label_domains(docs, labels.filter("doc_id < 200").withColumns({"quality": F.lit(1), "toxic": F.lit(0)})))
    assert model.domains == ["en", "fr"]
    rows = mixing.mix(docs, model, {"en": 0.4, "fr": 0.6}, least=least).collect()
    right = np.mean([model.domains[int(np.argmax(r["posterior"]))] == r["lang"] for r in rows if r["doc_id"] >= 200])
    assert right >= 0.97
    p = np.array([r["posterior"] for r in rows]) * np.array([[r["n_tokens"]] for r in rows])
    share = (p * np.array([[r["rate"]] for r in rows])).sum(axis=0)
    assert abs(share[1] / share.sum() - 0.6) < 0.02 and min(r["rate"] for r in rows) >= least
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)
    many = mixing.mix(odd(spark, docs), model, least=1.0)
    assert many.count() == 405 and many.filter("copies < 1").count() == 0
    assert mixing.mix(docs.limit(0), model).count() == 0
    assert mixing.fit_domains(docs, mixing.label_domains(docs, labels.limit(0))).domains == ["other"]
    clashing = docs.withColumnsRenamed({"doc_id": "id", "text": "body"}).withColumns({"v0": F.lit(1), "_row": F.lit(2), "i": F.lit(3), "x": F.lit(4)})
    assert mixing.mix(clashing, model, id_col="id", text_col="body").columns == [*clashing.columns, "n_tokens", "posterior", "rate", "copies"]


def test_domains_by_labels(spark, corpus):
    docs, labels = corpus
    model = mixing.fit_domains(docs, mixing.label_domains(docs, labels.filter("doc_id < 250")))
    assert model.domains == ["en", "fr", "poor", "toxic"]
    right = []
    for r in mixing.with_posteriors(docs, model).collect():
        if r["doc_id"] >= 250:
            rated = {3: "poor", 7: "toxic"}.get(r["doc_id"] % 10, r["lang"])
            right.append(r["posterior"][model.domains.index(rated)] >= 0.5)
    assert np.mean(right) >= 0.88  # a toxic text differs by one word


def least_squares(p, tokens, goal, least, ridge):
    """The optimum over rates themselves, by many projected gradient steps with momentum and restarts, each scaled by its row."""
    rates = before = np.ones(len(p))
    x = p * tokens[:, None]
    scaled = p / (p @ x.sum(axis=0))[:, None]
    top = np.linalg.eigvalsh(p.T @ x)[-1]
    weight, k, value = ridge * top, 1.0, np.inf
    most = np.linalg.eigvalsh((scaled.T @ x + x.T @ scaled) / 2)[-1] + weight * (tokens / (p @ x.sum(axis=0)))[tokens > 0].max()

    def objective(r):
        return ((r @ x - goal) ** 2).sum() / 2 + weight / 2 * (tokens * (r - 1) ** 2).sum()

    for _ in range(60_000):
        ahead = rates + (k - 1) / (k + 2) * (rates - before)
        gradient = scaled @ (ahead @ x - goal) + weight * (tokens / (p @ x.sum(axis=0))) * (ahead - 1)
        after = np.maximum(least, ahead - gradient / most)
        if (now := objective(after)) > value:
            k, before, value = 1.0, rates, objective(rates) * (1 + 1e-12)
            continue
        before, rates, value, k = rates, after, now, k + 1
    return objective(rates), float(np.linalg.norm(rates @ x - goal) / np.linalg.norm(goal))


@pytest.mark.parametrize("least", [0.0, 1.0])
@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.05, "b": 0.9, "c": 0.05}, {"a": 0.6, "b": 0.4, "c": 0.0}])
@pytest.mark.parametrize("scale", [1.0, 0.4])
def test_rates_reach_the_optimum(spark, least, weights, scale):
    """Feasible and infeasible targets, against steps over the rates themselves."""
    rng = np.random.default_rng(3)
    n, ridge = 600, 1e-4
    tokens = np.maximum(1, np.exp(rng.normal(4, 1, n))).astype(int)
    p = rng.dirichlet((0.5, 0.15, 0.1), n)
    members = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>").repartition(3)
    goal = scale * mixing.target_tokens(["a", "b", "c"], weights, tokens @ p, least)
    s = mixing.fit_rates(members, goal, least, ridge)
    rates = np.maximum(least, 1 - p @ s)
    miss = float(np.linalg.norm((rates * tokens) @ p - goal) / np.linalg.norm(goal))
    want, want_miss = least_squares(p, tokens.astype(float), goal, least, ridge)
    assert miss <= want_miss + 0.002
    weight = ridge * np.linalg.eigvalsh(p.T @ (p * tokens[:, None]))[-1]
    mine = (((rates * tokens) @ p - goal) ** 2).sum() / 2 + weight / 2 * (tokens * (rates - 1) ** 2).sum()
    assert mine <= 1.01 * want + 1e-7 * (goal**2).sum()


def test_stages_on_empty_and_odd_tables(spark, sf_dir):
    """No rows, and rows of nulls, empty texts and extra columns with names that operators use: each stage returns its columns."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clashing = {c: F.lit(1) for c in ("starts", "_id", "_row", "fp", "component", "id", "key", "posterior", "rate", "copies", "kept", "length", "value")}
    odd_rows = docs.limit(30).unionByName(docs.limit(2)).withColumns(clashing)
    empty_texts = odd_rows.limit(3).withColumns({"doc_id": F.lit(None).cast(docs.schema["doc_id"].dataType), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    for rows in (docs.limit(0), odd_rows.unionByName(empty_texts).withColumn("text", F.when(F.col("doc_id") == 3, "").otherwise(F.col("text")))):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == rows.columns, name
            assert out.count() >= (rows.count() > 0)
        assert p.STAGES[-1][1](spark, rows, sf_dir).count() >= rows.count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, ids = [], {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES:
        docs = p.common.materialize(stage(spark, docs, sf_dir), name)
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(now) <= ids
        ids = set(now)
        seen.append(len(now))
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert seen[0] >= seen[1] == seen[2] <= seen[3]
    assert p.run(spark, sf_dir).count() == seen[-1]
