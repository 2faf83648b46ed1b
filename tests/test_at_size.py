"""What goes wrong only in larger tables, in small copies of it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plinth.operators import ranking as K
from plinth.plans import registry


def written(df, folder, name, files=1):
    df.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(sf_dir, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    return con.execute(registry.oracle_sql()[name]).fetchall()


def test_a_small_negative_mean_keeps_its_sign(spark, tmp_path):
    rows = [(0, [-1e-7, 1e-7, 0.0, -0.25], 1), (1, [-2e-7, 2e-7, 0.0, 0.5], 1), (100, [-3e-7, -0.0000015, 1.0, 2.0], 2)]
    sf_dir = written(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tmp_path, "embeddings")
    got = [(r["qid"], list(r["query"])) for r in registry.queries()["i09_recommend_vector"](spark, sf_dir).collect()]
    want = by_sql(sf_dir, "i09_recommend_vector", "embeddings")
    assert sorted(map(repr, got)) == sorted(repr((q, list(v))) for q, v in want) and "-0.0," in repr(got)


def test_needles_of_a_large_corpus_differ(spark):
    from plinth.sources.synthetic import vault_corpus

    made = vault_corpus(spark, 12_345)
    assert made.select("needle").distinct().count() == made.select("key").distinct().count() == 12_345
    ids = {r["needle"].rsplit("_", 1)[1] for r in made.select("needle").collect()}
    assert {"007", "999", "1000", "12344"} <= ids


def test_buckets_are_made_where_the_texts_are(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 50).cast("int")).alias("text"))
    sf_dir = written(docs, tmp_path, "documents", 8)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        made = registry.queries()["e14_encode_buckets"](spark, sf_dir)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Coalesce 1" not in plan and [tuple(r) for r in made.collect()] == by_sql(sf_dir, "e14_encode_buckets", "documents")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_texts_have_no_buckets(spark, tmp_path):
    sf_dir = written(spark.createDataFrame([], "doc_id long, text string"), tmp_path, "documents")
    assert [tuple(r) for r in registry.queries()["e14_encode_buckets"](spark, sf_dir).collect()] == [(0, True)]


@pytest.mark.parametrize("block", [False, True])
def test_many_queries_take_little_memory(block):
    """10,000 rows against 4,000 queries: no array of all pairs, and from each task a query's best rows alone, the smaller id of equals first."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from plinth.operators import retrieval as R

    rng = np.random.default_rng(3)
    values, asked = rng.normal(size=(10_000, 8)), rng.normal(size=(4000, 8))
    values[5000:] = values[:5000]
    as_lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 8).cast(pa.list_(pa.float64()))
    rows = pa.table({"id": pa.array(np.arange(10_000)[::-1]), "vector": as_lists(values)})
    queries = pa.table({"qid": pa.array(np.arange(4000)), "query": as_lists(asked)})
    tracemalloc.start()
    got = R._part_against_block(20, 6)(rows, queries) if block else pa.Table.from_batches(list(R._against_matrix(asked, queries["qid"].combine_chunks(), 20, 6)(iter(rows.combine_chunks().to_batches()))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and got.num_rows == 20 * 4000, (peak, got.num_rows)
    scores = np.round(values @ asked[7] / np.linalg.norm(values, axis=1) / np.linalg.norm(asked[7]), 6)
    ids = np.arange(10_000)[::-1]
    assert sorted(got.filter(pa.compute.equal(got["qid"], 7))["id"].to_pylist()) == sorted(ids[np.lexsort((ids, -scores))[:20]].tolist())


def test_grades_join_no_pair_that_is_not_ranked(spark, sf_dir):
    """The queries' pairs with all rows are not joined; where all are needed, they are counted by grade."""
    for name in ("m02_m03_first_rank", "m04_m05_at_k"):
        assert "BroadcastNestedLoopJoin" not in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_ideal_of_many_grades(spark):
    from plinth.operators import evaluation as V

    gold = spark.range(1000).select(F.lit(1).alias("qid"), "id", (F.col("id") % 4).cast("int").alias("grade"))
    ranked = spark.createDataFrame([(1, 3, 1), (1, 2, 2)], "qid int, id long, rank int")
    import math

    ideal = sum(7 / math.log2(n + 1) for n in range(1, 11))
    assert abs(V.ndcg(ranked, gold, 10).first()["ndcg"] - (7 + 3 / math.log2(3)) / ideal) < 1e-9


def test_rerank_reads_whole_texts(spark, tmp_path):
    """Terms after thousands of characters count, also as the only ones by which two texts differ."""
    filler = "filler " * 1000
    docs = [(0, "alpha " * 1000, "en", "s"), (1, f"alpha {filler}Beta gamma", "en", "s"), (2, f"{filler * 20}alpha gamma", "en", "s"), (3, "nothing", "en", "s")]
    written(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), tmp_path, "documents")
    sf_dir = written(spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string"), tmp_path, "benchmark")
    got = sorted(map(tuple, registry.queries()["i18_f02_lexical_rerank"](spark, sf_dir).select("qid", "id", "pos").collect()))
    assert got == [(7, 0, 3), (7, 1, 1), (7, 2, 2)] == sorted(by_sql(sf_dir, "i18_f02_lexical_rerank", "documents", "benchmark"))


def test_lexical_score_cuts_no_word(spark):
    """A word over any number of characters is that word, not its beginning; repeats count once, and a text without words has no share."""
    terms = spark.createDataFrame([(0, "beta"), (0, "gamma"), (0, "gamma")], "qid long, term string")
    texts = [(0, 0, "x" * 6139 + " betamax"), (0, 1, "x" * 6144 + " gamma gamma"), (0, 2, "x " * 50_000 + "GAMMA beta beta"), (0, 3, "")]
    got = K.lexical_score(terms, spark.createDataFrame(texts, "qid long, id long, text string"))
    assert {r["id"]: r["rerank"] for r in got.collect()} == {0: 0.0, 1: 0.5, 2: 1.0, 3: 0.0}
