"""Versioned tables: merged reads, commits of two writers, crashes, compaction and expiry."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plinth.operators import versioned as V
from plinth.streaming import watch as W


def rows(spark, lo, hi, tag, step=1):
    return spark.range(lo, hi, step).select("id", F.lit(tag).alias("tag"), F.sha2(F.col("id").cast("string"), 512).alias("body"))


def bag(df):
    return sorted((r["id"], r["tag"]) for r in df.collect())


@pytest.fixture
def made(spark, tmp_path):
    t = V.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.versions() == []
    t.upsert(rows(spark, 0, 2000, "old"), ["id"], 4)
    return t


def size(table, folders):
    return sum(f.stat().st_size for x in folders for f in Path(table.base.removeprefix("file://"), "data", x).rglob("*.parquet"))


def test_a_hundredth_of_the_keys_writes_a_hundredth_of_the_bytes(spark, tmp_path):
    made = V.VersionedTable(spark, f"file://{tmp_path}/large")
    before = made.upsert(rows(spark, 0, 20_000, "old"), ["id"], 4).folders()
    whole = size(made, before)
    after = made.upsert(rows(spark, 0, 20_000, "new", 100))
    assert size(made, after.folders() - before) < 0.02 * whole
    assert bag(made.read()) == [(i, "old" if i % 100 else "new") for i in range(20_000)]


def test_last_write_wins_after_batches_deletes_and_compaction(spark, made):
    want = {i: "old" for i in range(2000)}
    for n in range(10):
        made.upsert(rows(spark, n * 7, 2100, f"b{n}", 13))
        want |= {i: f"b{n}" for i in range(n * 7, 2100, 13)}
        if n % 3 == 0:
            made.delete(spark.range(n, 2100, 17).toDF("id"))
            for i in range(n, 2100, 17):
                want.pop(i, None)
        if n == 6:
            made.compact(most_deltas=3)
    assert bag(made.read()) == sorted(want.items())
    assert max(n for n, _ in made.state().depth().values()) < 10
    made.compact(most_deltas=1)
    assert made.state().deltas == {} and bag(made.read()) == sorted(want.items())
    assert bag(made.read(version=1)) == [(i, "old") for i in range(2000)]
    assert bag(made.read(keys=[(13,), (17,), (99_999,)])) == sorted((k, v) for k, v in want.items() if k in (13, 17))


def test_keys_read_their_buckets_alone(spark, made):
    files = {f.split("/_b=")[1].split("/")[0] for f in made.read(keys=[(5,)]).inputFiles()}
    assert len(files) == 1 and len({f.split("/_b=")[1].split("/")[0] for f in made.read().inputFiles()}) == 4


def test_two_writers_at_once_both_land(spark, made):
    failed = []

    def write(tag, lo):
        try:
            for n in range(4):
                made.upsert(rows(spark, lo + n, 4000, tag, 50))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=x) for x in (("left", 2000), ("right", 2010))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and made.versions() == list(range(1, 10))
    got = dict(bag(made.read()))
    assert all(got[i] == ("left" if (i - 2000) % 50 < 4 else "right") for i in got if i >= 2000) and sum(i >= 2000 for i in got) == 320


def test_a_write_that_depends_on_changed_buckets_is_made_again(spark, made):
    calls = []

    def add_one(now):
        calls.append(1)
        if len(calls) == 1:
            made.upsert(rows(spark, 1, 2, "between"))  # another writer, after the first read
        return now.filter("id = 1").withColumn("tag", F.concat("tag", F.lit("+"))), None

    made.change(add_one, depends="own")
    assert len(calls) == 2 and dict(bag(made.read()))[1] == "between+"
    calls.clear()
    other = next(i for i in range(2, 50) if made.read(keys=[(i,)]).inputFiles() != made.read(keys=[(1,)]).inputFiles())

    def elsewhere(now):
        calls.append(1)
        if len(calls) == 1:
            made.upsert(rows(spark, other, other + 1, "else"))
        return rows(spark, 1, 2, "own"), None

    made.change(elsewhere, depends="own")
    assert len(calls) == 1 and {1: "own", other: "else"}.items() <= dict(bag(made.read())).items()


def test_replacements(spark, made):
    at = made.state().version
    with pytest.raises(ValueError):
        made.replace(rows(spark, 0, 3, "short"), expected=4)
    made.upsert(rows(spark, 5000, 5001, "new"))
    with pytest.raises(V.Conflict):
        made.replace(rows(spark, 0, 3, "stale"), made_from=at)
    assert len(bag(made.read())) == 2001
    made.replace(rows(spark, 0, 3, "all"), made_from=made.state().version, expected=3)
    assert bag(made.read()) == [(0, "all"), (1, "all"), (2, "all")]
    assert made.reset().version == 4 and bag(made.read()) == []


def test_a_writer_that_dies_leaves_nothing_that_shows(spark, made, monkeypatch):
    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(V, "put_if_absent", dies)
    with pytest.raises(KeyboardInterrupt):
        made.upsert(rows(spark, 0, 2000, "lost"))
    monkeypatch.undo()
    assert made.versions() == [1] and set(dict(bag(made.read())).values()) == {"old"}
    assert len(made.expire(grace_seconds=-5)) == 1 and len(bag(made.read())) == 2000


def test_a_compaction_keeps_what_came_meanwhile(spark, made):
    made.upsert(rows(spark, 0, 2000, "a", 2))
    write = made._write

    def late(df, key, buckets):
        out = write(df, key, buckets)
        made._write = write
        made.upsert(rows(spark, 0, 2000, "b", 4))
        return out

    made._write = late
    made.compact(most_deltas=1)
    assert bag(made.read()) == [(i, "b" if i % 4 == 0 else "a" if i % 2 == 0 else "old") for i in range(2000)]
    assert {n for n, _ in made.state().depth().values()} == {1}
    assert made.expire(grace_seconds=-5) and bag(made.read(keys=[(4,)])) == [(4, "b")]


def test_many_versions_are_read_from_a_snapshot(spark, tmp_path):
    t = V.VersionedTable(spark, f"file://{tmp_path}/s")
    for n in range(12):
        t.upsert(rows(spark, n, n + 1, f"v{n}"), ["id"], 2)
    assert Path(tmp_path, "s", "log", f"{10:020d}.snapshot").exists()
    assert bag(t.read()) == [(n, f"v{n}") for n in range(12)] and bag(t.read(version=3)) == [(n, f"v{n}") for n in range(3)]


def test_a_batch_that_runs_again_is_there_once(spark, sf_dir, tmp_path):
    from plinth.plans.streams import stream

    base, state = f"file://{tmp_path}/u", f"file://{tmp_path}/state"
    rows_of = lambda: stream(spark, sf_dir).select("user_id", "event_id")
    t = W.upsert_stream(rows_of(), base, state, ["user_id"], [F.desc("event_id")])
    want, versions = sorted(map(tuple, t.read().collect())), t.versions()
    commits = sorted(Path(tmp_path, "state", "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the crash came between the table's commit and the stream's
        f.unlink(missing_ok=True)
    again = W.upsert_stream(rows_of(), base, state, ["user_id"], [F.desc("event_id")])
    assert sorted(map(tuple, again.read().collect())) == want and again.versions() == versions


def test_no_task_sorts_more_rows_as_the_table_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "TASK_ROWS", 500, raising=False)
    most = lambda df: df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    for n in (2000, 8000):
        t = V.VersionedTable(spark, f"file://{tmp_path}/g{n}")
        t.upsert(rows(spark, 0, n, "old"), ["id"], 2)
        files = t.read().groupBy(F.input_file_name()).count()
        assert files.agg(F.max("count")).first()[0] < 900 and files.count() >= n // 500
        t.upsert(rows(spark, 0, n, "a", 2))
        t.upsert(rows(spark, 0, n, "b", 3))
        t.delete(spark.range(0, n, 5).toDF("id"))
        want = [(i, "b" if i % 3 == 0 else "a" if i % 2 == 0 else "old") for i in range(n) if i % 5]
        assert most(t.read()) < 900 and bag(t.read()) == want
        assert sum(f["rows"] for f in t.state().bases.values()) == n and sum(d["rows"] for ds in t.state().deltas.values() for d in ds) == n // 2 + len(range(0, n, 3)) + n // 5
        t.compact(most_deltas=1)
        assert t.read().groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 900 and bag(t.read()) == want
        kept = t.upsert(rows(spark, 0, 10, "new"))
        assert bag(t.read(where=F.col("tag") == "new")) == [(i, "new") for i in range(10)] and kept.folders() == t.state().folders()
        data = Path(tmp_path, f"g{n}", "data")
        assert {f.name for f in data.iterdir()} >= kept.folders() and t.expire(grace_seconds=-5) and {f.name for f in data.iterdir()} == kept.folders()


def test_filters_read_the_files_that_hold_them(spark, tmp_path):
    docs = spark.range(4000).select("id", F.concat(F.lit("p"), F.floor(F.col("id") / 20).cast("string")).alias("path"), F.array(F.concat(F.lit("t"), F.floor(F.col("id") / 40).cast("string")), F.lit("all")).alias("tags"))
    t = V.VersionedTable(spark, f"file://{tmp_path}/i", ["path", "tags"])
    t.upsert(docs, ["path", "id"], 64)
    read = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    one = t.read(holding={"path": ["p7"]})
    assert sorted(r["id"] for r in one.collect()) == list(range(140, 160))
    assert len(one.inputFiles()) < 25 < len(t.read().inputFiles()) == 64 and read(one) <= set(one.inputFiles())
    both = t.read(holding={"path": ["p7", "p100"], "tags": ["t3"]})
    assert sorted(r["id"] for r in both.collect()) == list(range(140, 160))
    assert t.read(holding={"path": ["none"]}).collect() == []
    t.upsert(docs.filter("id in (141, 999)").withColumn("tags", F.array(F.lit("t3"))))
    t.upsert(docs.filter("id = 142").withColumn("tags", F.lit(None).cast("array<string>")))
    assert sorted(r["id"] for r in t.read(holding={"tags": ["t3"]}).collect()) == sorted({*range(120, 160), 999} - {142})
    t.compact(most_deltas=1)
    assert sorted(r["id"] for r in t.read(holding={"tags": ["t3"]}).collect()) == sorted({*range(120, 160), 999} - {142})
    V.VersionedTable(spark, t.base).upsert(docs.filter("id = 0").withColumn("tags", F.array(F.lit("t3"))))  # a writer without indexes
    assert 0 in {r["id"] for r in t.read(holding={"tags": ["t3"]}).collect()}
