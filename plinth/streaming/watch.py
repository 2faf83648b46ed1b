"""Update streams: merging, sessions, duplicates within a watermark, keyed state, and micro-batch upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plinth.operators import catalog as C
from plinth.operators import versioned as V
from plinth.streaming.machines import Pressure, Retry

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 4) -> DataFrame:
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    # Watermarks want times with a zone.
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def owned_changes(events: DataFrame, routes: DataFrame) -> DataFrame:
    """events (path, ...) once for each source whose routes (pattern, source) match the path; deletes of no route keep their last_owner."""
    matched = events.join(F.broadcast(routes), F.expr("path rlike pattern"), "left")
    owner = F.coalesce(F.col("source"), F.when(F.col("kind") == "delete", F.col("last_owner")))
    return matched.withColumn("source", owner).filter("source is not null").drop("pattern")


def merged(events: DataFrame, at: str, keys: list[str], kind: str, late: str | None = LATE) -> DataFrame:
    """Pending changes by keys; the same over a stream and over a table."""
    rows = events.withWatermark(at, late) if late and events.isStreaming else events
    return rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("latest_at"), F.sort_array(F.collect_set(kind)).alias("kinds"))


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str = LATE) -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap, late: str = LATE) -> DataFrame:
    """(key, start, last, n): runs of events with less than gap between them. gap: a duration or a column of durations."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One event a key within the watermark; over a table one a key."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def retry_states(events: DataFrame, key: str, at: str, outcome: str) -> DataFrame:
    """(key, failures, circuit, retry_at) after each batch of outcomes (ok, failed, fatal) by key, in time order."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Retry(*state.get) if state.exists else Retry()
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        for t, what in zip(rows[at], rows[outcome], strict=True):
            now = now.succeeded() if what == "ok" else now.failed(float(t), what != "fatal")
        state.update((now.failures, now.circuit, now.retry_at))
        yield pd.DataFrame([(keys[0], now.failures, now.circuit, now.retry_at)], columns=[key, "failures", "circuit", "retry_at"])

    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, failures int, circuit string, retry_at double"
    return events.groupBy(key).applyInPandasWithState(step, out, "failures int, circuit string, retry_at double", "update", GroupStateTimeout.NoTimeout)


def folded(events: DataFrame, key: str, at: str, schema: str, fold: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The batch twin of keyed state: each key's events in time order through fold."""
    return events.groupBy(key).applyInPandas(lambda rows: fold(rows.sort_values(at, kind="stable")), schema)


def fold_retry(key: str, at: str, outcome: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        now = Retry()
        for t, what in zip(rows[at], rows[outcome], strict=True):
            now = now.succeeded() if what == "ok" else now.failed(float(t), what != "fatal")
        return pd.DataFrame([(rows[key].iloc[0], now.failures, now.circuit, now.retry_at)], columns=[key, "failures", "circuit", "retry_at"])

    return fold


def fold_pressure(key: str, at: str, raw: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        now, tiers = Pressure(), []
        for t, r in zip(rows[at], rows[raw], strict=True):
            now = now.sample(int(r), float(t))
            tiers.append(now.tier)
        return pd.DataFrame({key: rows[key].to_numpy(), at: rows[at].to_numpy(), "tier": tiers})

    return fold


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends. Complete results replace the table batch by batch; update results are added to it."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_stream(stream: DataFrame, base: str, checkpoint: str, key: list[str], order: list) -> V.VersionedTable:
    """Micro-batches as upserts of a versioned table: each one's latest rows by key, in files of their own.

    A commit carries the stream's name (its checkpoint) and the batch's number, so a batch that is run again after a crash,
    whether that came before or after its commit, is there once. Buckets that have gathered many deltas are compacted.
    """
    table = V.VersionedTable(stream.sparkSession, base)

    def batch(df: DataFrame, n: int) -> None:
        table.upsert(C.latest(df, key, order), key, stream=(checkpoint, n))
        table.compact()

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return table
