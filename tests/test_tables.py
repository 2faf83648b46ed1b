"""Table functions in SQL, and streams with timers."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import chunk as K
from plinth.functions import tables
from plinth.streaming import timers as T
from plinth.streaming import watch as W


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["word ", "a. ", "\n", "\n\n", "# Head\n", "é", "x" * 40]) for _ in range(r.randint(0, 120)))) for i in range(40)] + [(98, None), (99, "")]
    tables.register(spark)
    spark.createDataFrame(rows, "id int, text string").createOrReplaceTempView("texts")
    return rows


def test_split_text_by_lateral(spark, texts):
    got = spark.sql("select t.id, c.* from texts t, lateral split_text(t.text, 60, 'text') c").collect()
    for i, text in texts:
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["ordinal"])
        assert [r["content"] for r in mine] == K.split_text(text or "", 60)
        assert all(text[r["start"] :].startswith(r["content"]) and r["line_start"] == 1 + text.count("\n", 0, r["start"]) for r in mine)


def test_records_and_code(spark, texts):
    got = spark.sql("select t.id, c.* from texts t, lateral split_record(t.text, 200) c").collect()
    for i, text in texts:
        want = K.split_record(text or "", 200)
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["ordinal"])
        assert [(r["content"], r["line_start"], r["line_end"], r["section"], [p.asDict() for p in r["passages"]]) for r in mine] == [(c["content"], c["line_start"], c["line_end"], c["section"], c["passages"]) for c in want]
    code = spark.sql("select c.* from lateral split_code('def f():\\n    return 1\\n', 'a.py', 'python') c").collect()
    assert [r["function_name"] for r in code] == ["f"]


def test_greedy_segments_over_a_partitioned_table(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 50), i) for i in range(200)]
    spark.createDataFrame(rows, "g string, size long, item int").createOrReplaceTempView("items")
    got = {int(x["item"]): x["segment"] for x in spark.sql("select * from greedy_segments(5, 100, table(items) partition by g order by item)").collect()}
    for g in ("a", "b", None):
        own = [(i, s) for x, s, i in rows if x == g]
        assert [got[i] for i, _ in own] == K.pack_greedy([s for _, s in own], 5, 100)


def fired_by_hand(events, quiet, most, watermark):
    out = []
    for user in {u for u, _ in events}:
        now = None
        for t in sorted(t for u, t in events if u == user):
            if now and t >= min(now[1] + quiet, now[0] + most):
                out.append((user, *now))
                now = None
            now = (now[0], t, now[2] + 1) if now else (t, t, 1)
        if now and min(now[1] + quiet, now[0] + most) <= watermark:
            out.append((user, *now))
    return sorted(out)


@pytest.mark.parametrize("stops", [[], [3]])
def test_timers_fire_without_further_events(spark, tmp_path, stops):
    """Whatever the batches, and after a restart in the middle."""
    r = random.Random(9)
    times = sorted(r.randint(0, 40_000) for _ in range(400))
    events = [(r.randint(0, 12), t) for t in times]
    path = tmp_path / "in"
    for k in range(8):
        part = events[k * 50 : k * 50 + 50]
        spark.createDataFrame([(u, t * 10**6) for u, t in part], "user long, us long").select("user", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"file://{path}")
    files = sorted(path.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    late = [(f, f.with_name(f".{f.name}.later")) for f in files[stops[0] :]] if stops else []
    for f, hidden in late:
        f.rename(hidden)

    def run():
        rows = spark.readStream.schema("user long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{path}")
        W.run_to_table(T.coalesced(rows, "user", "ts", 600, 3000), f"file://{tmp_path}/out", f"file://{tmp_path}/state")

    if late:
        run()
        for f, hidden in late:
            hidden.rename(f)
    run()
    got = sorted((x["user"], x["f"], x["l"], x["n"]) for x in spark.read.parquet(f"file://{tmp_path}/out").select("user", "n", F.unix_seconds("first_at").alias("f"), F.unix_seconds("latest_at").alias("l")).collect())
    assert got == fired_by_hand(events, 600, 3000, times[-1])
