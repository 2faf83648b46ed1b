"""Streams over the events, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import catalog as C
from plinth.plans.base import Plans, table
from plinth.sources.files import scratch
from plinth.streaming import watch as W

plans = Plans()
QUERIES, SQL = plans.queries, plans.sql


def stream(spark, sf_dir):
    return W.event_stream(spark, f"{sf_dir}/event*.parquet", table(spark, sf_dir, "events"))


@plans.add("j01_j04_stream_merge", "select user_id, event_type, min(ts) as first_at, max(ts) as latest_at, list_sort(list(distinct case when value > 50 then 'modify' else 'add' end)) as kinds from events group by 1, 2")
def merged(spark, sf_dir):
    top = scratch(spark)
    rows = stream(spark, sf_dir).withColumn("kind", F.when(F.col("value") > 50, "modify").otherwise("add"))
    W.run_to_table(W.merged(rows, "ts", ["user_id", "event_type"], "kind", None), f"{top}/out", f"{top}/state", "complete")
    return spark.read.parquet(f"{top}/out")


@plans.add("j20_stream_tumbling", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def hourly(spark, sf_dir):
    top = scratch(spark)
    W.run_to_table(W.tumbling(stream(spark, sf_dir), "ts", "1 hour", ["event_type"], "100 days"), f"{top}/out", f"{top}/state", "complete")
    return spark.read.parquet(f"{top}/out")


@plans.add("j05_session_coalescing", "select user_id, min(ts) as start, max(ts) as last, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts) as s from (select *, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval '6 hours')::int, 1) as fresh from events)) group by user_id, s")
def sessions(spark, sf_dir):
    return W.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


@plans.add("j16_first_seen", "select distinct user_id, event_type from events")
def seen(spark, sf_dir):
    top = scratch(spark)
    W.run_to_table(W.first_seen(stream(spark, sf_dir), "ts", ["user_id", "event_type"], "100 days").select("user_id", "event_type"), f"{top}/out", f"{top}/state")
    return spark.read.parquet(f"{top}/out")


@plans.add("j02_j03_owned_changes", "select event_id, 'code' as source from events where event_type in ('click', 'view') union all select event_id, 'vault' from events where event_type like 'v%' union all select event_id, 'old' from events where event_type = 'purchase' and value > 50")
def owned(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("path"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), "delete").otherwise("modify").alias("kind"), F.lit("old").alias("last_owner"))
    routes = spark.createDataFrame([("^(click|view)$", "code"), ("^v", "vault")], "pattern string, source string")
    return W.owned_changes(e, routes).select("event_id", "source")


@plans.add("j21_j23_upsert_stream", "select user_id, max(event_id) as event_id from events group by user_id")
def upserts(spark, sf_dir):
    top = scratch(spark)
    rows = stream(spark, sf_dir).select("user_id", "event_id")
    made = W.upsert_stream(rows, f"{top}/table", f"{top}/state", ["user_id"], [F.desc("event_id")])
    made.upsert(made.read().limit(1).withColumn("event_id", F.lit(-1).cast("long")), stream=(f"{top}/state", 0))  # a batch that is there already changes nothing
    return made.read()


_PENDING_SQL = """with recursive e as (select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as nth from events),
  s as (select user_id, nth, t as first_us, t as latest_us, 1::bigint as n, null::bigint as f, null::bigint as l, null::bigint as m from e where nth = 1 union all
    select e.user_id, e.nth, case when late then e.t else s.first_us end, e.t, case when late then 1 else s.n + 1 end, case when late then s.first_us end, case when late then s.latest_us end, case when late then s.n end
    from (select *, least(latest_us + 21600000000, first_us + 86400000000) as due from s) s join e on e.user_id = s.user_id and e.nth = s.nth + 1, lateral (select e.t >= s.due as late)),
  done as (select user_id, f as first_us, l as latest_us, m as n from s where m is not null union all
    select user_id, first_us, latest_us, n from s qualify row_number() over (partition by user_id order by nth desc) = 1 and ceil(least(latest_us + 21600000000, first_us + 86400000000) / 1000) <= (select max(epoch_us(ts)) // 1000 from events))"""


@plans.add("j06_j08_timers", f"{_PENDING_SQL} select user_id, first_us, latest_us, n, least(latest_us + 21600000000, first_us + 86400000000) as fired_us from done")
def timers(spark, sf_dir):
    """Changes by user that fire six quiet hours after the last, or a day after the first, by event-time timers."""
    from plinth.streaming import timers as T

    top = scratch(spark)
    fired = T.coalesced(stream(spark, sf_dir), "user_id", "ts", 6 * 3600, 24 * 3600)
    W.run_to_table(fired, f"{top}/out", f"{top}/state")
    return spark.read.schema(fired.schema).parquet(f"{top}/out").select("user_id", "n", *(F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("first", "latest", "fired")))


def outcomes(df):
    """Failures by event, in seconds; a tenth can't be tried again."""
    what = F.when(F.col("value") > 60, "ok").when(F.col("event_id") % 10 == 0, "fatal").otherwise("failed")
    return df.select("user_id", F.col("event_id").cast("double").alias("at"), what.alias("outcome"))


@plans.add("j11_j12_retry_circuit")
def retries(spark, sf_dir):
    return W.folded(outcomes(table(spark, sf_dir, "events")), "user_id", "at", "user_id long, failures int, circuit string, retry_at double", W.fold_retry("user_id", "at", "outcome"))


@plans.add("j15_pressure_hysteresis")
def pressure(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 5.0).alias("at"), F.when(F.col("value") > 70, 2).when(F.col("value") > 30, 1).otherwise(0).alias("raw"))
    return W.folded(e, "user_id", "at", "user_id long, at double, tier int", W.fold_pressure("user_id", "at", "raw"))
