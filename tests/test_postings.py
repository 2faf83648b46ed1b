"""Searches that skip blocks give what all postings give, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import postings as P
from plinth.operators import retrieval as R


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(3000)], k=int(3 * 2 ** (rng.random() * 9)))), rng.choice(["en", "fr"])) for i in range(4000)]
    postings = R.term_weights(spark.createDataFrame(texts, "id long, text string, lang string").repartition(3))
    queries = [(q, " ".join(rng.choices(words[:400], k=rng.choice([1, 3, 8, 30])))) for q in range(30)] + [(99, "absent")]
    terms = R.term_weights(spark.createDataFrame(queries, "id long, text string")).select(F.col("id").alias("qid"), "term", F.col("weight").alias("q"))
    return postings, P.store(postings, f"file://{tmp_path_factory.mktemp('p')}/index"), terms


def bag(df):
    return sorted((r["qid"], r["id"], r["rank"], r["score"]) for r in df.select("qid", "id", F.round("score", 9).alias("score"), "rank").collect())


@pytest.mark.parametrize("limit", [1, 10, 200])
def test_the_same_rows(spark, made, limit):
    postings, index, terms = made
    assert bag(index.top(terms, limit, 6)) == bag(R.sparse_leg(postings, terms, limit, 6))


def test_filters(spark, made):
    postings, index, terms = made
    assert bag(index.top(terms, 10, 6, where=F.col("lang") == "fr")) == bag(R.sparse_leg(postings.filter("lang = 'fr'"), terms, 10, 6))
    ids = spark.range(0, 4000, 7)
    assert bag(index.top(terms, 10, 6, ids=ids)) == bag(R.sparse_leg(postings.filter("id % 7 = 0"), terms, 10, 6))


def test_most_postings_of_the_documents_are_not_read(spark, tmp_path):
    """Of the postings of its terms, a search of the documents by all benchmark items reads under a third; most of the time under a fifth."""
    from plinth.plans import retrieval as plans

    sf_dir = "/root/testdata/sf0.1"
    index = P.store(R.term_weights(plans.texts(spark, sf_dir)), f"file://{tmp_path}/index")
    terms, parts = plans.query_terms(spark, sf_dir), []
    index.top(terms, 10, 6, read=parts)
    read = sum(p.agg(F.sum("n")).first()[0] or 0 for p in parts)
    every = index.bounds().join(terms, "term").agg(F.sum("n")).first()[0]
    assert 0 < read < every / 3, (read, every)


def test_empty(spark, tmp_path):
    postings = R.term_weights(spark.createDataFrame([], "id long, text string"))
    index = P.store(postings, f"file://{tmp_path}/e")
    terms = spark.createDataFrame([(1, "a", 1.0)], "qid int, term string, q double")
    assert index.top(terms, 5).collect() == []


def test_a_large_search_shuffles_no_postings(spark, made, monkeypatch):
    """Where more (query, block, term) rows are wanted than are broadcast, postings still stay in the tasks that read them."""
    postings, index, terms = made
    plans, rank = [], P.ranked
    monkeypatch.setattr(P, "MOST_HELD", 10)
    monkeypatch.setattr(P, "ranked", lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or rank(df, n))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = bag(index.top(terms, 10, 6))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == bag(R.sparse_leg(postings, terms, 10, 6))
    assert plans and not any("hashpartitioning(block" in p for p in plans)


def test_files_hold_whole_blocks_and_bounds_are_theirs(spark, made, tmp_path, monkeypatch):
    """With small splits, batches that end within terms, and files of few rows."""
    monkeypatch.setattr(P, "FILE_ROWS", 5000)
    twice = spark.createDataFrame([(i, f"a b w{i} " * (1 + i % 40) + "c d e " * (i % 7)) for i in range(2000)], "id long, text string")
    postings = R.term_weights(twice, totals=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        index = P.store(postings, f"file://{tmp_path}/i")
        rows = index.rows()
        assert rows.select("block", F.col("_metadata.file_name").alias("file")).distinct().groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").count() == 0
        assert rows.groupBy("id").agg(F.count_distinct("block").alias("n")).filter("n > 1").count() == 0
        want = rows.groupBy("block", "term").agg(F.max("weight").alias("most"), F.count("*").alias("n"))
        assert sorted(map(tuple, index.bounds().select("block", "term", "most", "n").collect())) == sorted(map(tuple, want.collect()))
        terms = spark.createDataFrame([(q, t, 1.0 + q) for q in range(9) for t in ("a", "c", f"w{q * 7}", "w1")], "qid int, term string, q double")
        assert bag(index.top(terms, 10, 6)) == bag(R.sparse_leg(postings, terms, 10, 6))
        ids = spark.range(0, 2000, 3)
        assert bag(index.top(terms, 10, 6, ids=ids)) == bag(R.sparse_leg(postings.filter("id % 3 = 0"), terms, 10, 6))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_storing_reads_little_in_a_task(spark, tmp_path, monkeypatch):
    """What a task deals out or gathers for bounds is of a small split, at any size, in a session whose settings are its own."""
    from pyspark.sql.classic.dataframe import DataFrame

    postings = R.term_weights(spark.range(3000).select("id", F.concat_ws(" ", F.lit("a b"), F.concat(F.lit("w"), F.col("id") % 97), F.concat(F.lit("x"), "id")).alias("text")), totals=True)
    grouped, dealt, group, deal = {}, [], DataFrame.groupBy, DataFrame.repartition
    before = [spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")]
    monkeypatch.setattr(P, "SPLIT", 4096, raising=False)
    monkeypatch.setattr(P, "FILE_ROWS", 1000)
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *cols: grouped.setdefault(cols, self.rdd.getNumPartitions()) and group(self, *cols))
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *to: dealt.append(self.rdd.getNumPartitions()) or deal(self, *to))
    index = P.store(postings, f"file://{tmp_path}/s")
    monkeypatch.undo()
    assert grouped[("block", "term")] > 8 and dealt[0] > 8
    assert before == [spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")]
    want = index.rows().groupBy("block", "term").agg(F.max("weight").alias("most"), F.count("*").alias("n"))
    assert sorted(map(tuple, index.bounds().select("block", "term", "most", "n").collect())) == sorted(map(tuple, want.collect()))
