import pytest
from pyspark.sql import functions as F

from plinth.api import Engine, FilterError, validated
from plinth.operators import schema as M
from plinth.sources import preprocess as X
from plinth.streaming import watch as W


def emit(path, content):
    return {"schema_version": 1, "units": [{"text": content.decode() + " unit", "title": path}]}


def test_search_end_to_end(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/tables")
    assert e.search_combined("anything") is None and e.status() == {"vault": 0, "codebase": 0, "document": 0}
    records = spark.createDataFrame(
        [("adr/one", "---\ntype: adr\ntags: ['#adr', '#cache']\nrelated: ['plan/two']\n---\n# Cache policy | (**status:** `accepted`)\nThe zebra cache evicts old rows."),
         ("plan/two", "---\ntype: plan\ntags: ['#plan', '#cache']\n---\n# Plan\nBuild the zebra cache."),
         ("adr/old", "---\ntype: adr\ntags: ['#adr']\n---\n# Old | (**status:** `superseded`)\nThe zebra cache is gone.")], "key string, content string")
    files = spark.createDataFrame([("src/cache.py", "def zebra():\n    return 1\n"), ("tests/test_cache.py", "def test_zebra():\n    assert zebra() == 1\n"), (".git/worktrees/w/a.py", "def zebra():\n    pass\n")], "path string, content string")
    units = spark.createDataFrame([("a.pdf", 0, "zebra facts", "Facts", None)], "path string, ordinal int, text string, title string, section string")
    out = e.index_all(vault=records, codebase=files, document=units)
    assert out["vault"]["chunks"] == 3 and out["codebase"]["chunks"] == 3 and out["document"]["chunks"] == 1
    hits = [r["id"] for r in e.search_vault("zebra cache").orderBy("pos").collect()]
    assert hits[0] == "adr/one" and set(hits) == {"adr/one", "plan/two", "adr/old"}
    assert {r["id"] for r in e.search_vault("zebra", status="active").collect()} == {"adr/one", "plan/two"}
    assert {r["id"] for r in e.search_vault("zebra type:plan").collect()} == {"plan/two"}
    code = [r["path"] for r in e.search_codebase("zebra").orderBy("pos").collect()]
    assert code == ["src/cache.py", "tests/test_cache.py"]
    assert {r["source"] for r in e.search_combined("zebra", 10).collect()} == {"vault", "codebase", "document"}
    again = records.filter("key = 'plan/two'").withColumn("content", F.concat("content", F.lit(" Soon.")))
    assert e.index(again, changed=again.select(F.col("key").alias("path")))["chunks"] == 3
    assert e.list_documents("plan").count() == 1
    assert e.clean("document") == ["document"] and e.status()["document"] == 0


def test_feedback_passages_and_versions(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/tables")
    long = "\n\n".join(["Filler words about nothing at all. " * 20, "The quokka valve opens here. " * 12, "More filler text to end with. " * 20])
    records = spark.createDataFrame([(f"plan/{n}", f"---\ntype: plan\n---\n# {n}\n{body}") for n, body in (("a", long), ("b", "red green blue"), ("c", "red green yellow"), ("d", "other words"))], "key string, content string")
    e.index(records)
    first = e.search_vault("quokka valve").orderBy("pos").first()
    assert first["id"] == "plan/a" and "quokka" in first["snippet"]
    before = {r["id"]: r["rank"] for r in e._page("vault", "red", 4, {})[0].collect()}
    e.feedback["vault"] = (["plan/c", "gone"], ["plan/b"])
    after = e._dense_query("vault", "red").first()["query"]
    e.feedback.clear()
    assert set(before) >= {"plan/b#c0", "plan/c#c0"} and list(after) != list(e._dense_query("vault", "red").first()["query"])
    version = e.versions("vault").state().version
    with pytest.raises(ValueError):
        e.versions("vault").replace(e.table("vault"), expected=-1)
    assert e.versions("vault").state().version == version
    e.index(records.limit(0), changed=records.limit(1).select(F.col("key").alias("path")))
    assert e.versions("vault").state().version == version + 1 and e.search_vault("red green") is not None
    for _ in range(3):
        e.index(records)
    names = {p.name for p in (tmp_path / "tables" / "vault").glob("p_*")}
    assert names == {e.versions("vault").state(v).note["postings"] for v in e.versions("vault").versions()[-2:]}


def test_two_indexers_at_once_lose_nothing(spark, tmp_path):
    """One indexes while another has read the table already: its rows are made anew."""
    e = Engine(spark, f"file://{tmp_path}/tables")
    record = lambda name: spark.createDataFrame([(name, f"---\ntype: plan\n---\n# {name}\nbody of {name}")], "key string, content string")
    e.index(record("plan/one"))
    current, other = e._current, Engine(spark, f"file://{tmp_path}/tables")

    def late(*given):
        e._current = current
        other.index(record("plan/two"), changed=spark.createDataFrame([("plan/two",)], "path string"))
        return current(*given)

    e._current = late
    e.index(record("plan/three"), changed=spark.createDataFrame([("plan/three",)], "path string"))
    assert {r["doc"] for r in e.table("vault").collect()} == {"plan/one", "plan/two", "plan/three"}
    assert {r["id"] for r in e.search_vault("body", 5).collect()} == {"plan/one", "plan/two", "plan/three"}


def test_filters():
    with pytest.raises(FilterError):
        validated("vault", {"language": "python"})
    with pytest.raises(FilterError):
        validated("vault", {"doc_type": "nope"})
    assert validated("codebase", {"prefer": "tests", "language": ""}) == {"prefer": "tests"}


def test_extract(spark):
    rules = [X.Rule("*", "r", entry_point="tests.test_engine:emit"), X.Rule("*", "bad", command=("false",), on_error="fail")]
    files = spark.createDataFrame([("a", bytearray(b"x"), "r"), ("b", bytearray(b"y"), "bad")], "path string, content binary, rule string")
    with pytest.raises(PermissionError):
        X.extract(files, rules, set())
    got = {r["path"]: (r["state"], r["text"]) for r in X.extract(files, rules, {X.policy_digest(rules)}).collect()}
    assert got == {"a": ("ok", "x unit"), "b": ("failed", None)}


def test_stream_and_batch_agree(spark, sf_dir, tmp_path):
    from plinth.plans.streams import outcomes, stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = W.folded(outcomes(events), "user_id", "at", "user_id long, failures int, circuit string, retry_at double", W.fold_retry("user_id", "at", "outcome"))
    rows = W.retry_states(outcomes(stream(spark, sf_dir)), "user_id", "at", "outcome")
    W.run_to_table(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "update")
    assert sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out").collect())) == sorted(map(str, batch.collect()))


def test_payload_errors(spark):
    df = spark.createDataFrame([], M.schema("vault_docs")).drop("title").withColumn("body_line", F.lit("x"))
    assert {tuple(r) for r in M.payload_errors(df, "vault_docs").collect()} == {("title", "missing"), ("body_line", "is string")}
