"""Chunk tables: reads, writes as new rows, and the joins that keep them current.

A table is a DataFrame with a key. Writes here give the new rows; versioned.VersionedTable commits them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plinth.operators.retrieval import checked_broadcast


def by_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among keys."""
    return df.join(checked_broadcast(keys.select(on).distinct()), on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key isn't among keys; null keys stay."""
    return df.join(checked_broadcast(keys.select(on).distinct()), on, "left_anti")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """df with rows in place of those of equal key. rows have one row a key, and df's columns."""
    return df.join(rows.select(*key), key, "left_anti").unionByName(rows.select(df.columns))


def fresh_payload(df: DataFrame, payload: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Rows of new payload columns with the old kept ones (vectors); payload rows without an old row are left out."""
    return payload.join(df.select(key, *kept), key).select(df.columns)


def replace_payload(df: DataFrame, payload: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """df with fresh_payload() in place of the rows of its keys; old rows without new payload stay."""
    return df.join(payload.select(key), key, "left_anti").unionByName(fresh_payload(df, payload, key, kept))


def page_after(df: DataFrame, key: list[str], last: list | None, limit: int) -> DataFrame:
    """The next limit rows (1 to 1000) in key order after last, by comparing the keys as one row."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    rows = df
    if last is not None:
        rows = df.filter(F.struct(*(F.col(k) for k in key)) > F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, last, strict=True))))
    return rows.orderBy(*key).limit(limit)


def one_per_document(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return df.filter((F.col(ordinal) == 0) | F.col(ordinal).isNull())


def chunk_counts(df: DataFrame) -> DataFrame:
    """(doc, chunks): the highest ordinal and one; rows without an ordinal count as one chunk."""
    return df.groupBy("doc").agg(F.max(F.coalesce(F.col("ordinal") + 1, F.lit(1))).alias("chunks"))


def ordinals(df: DataFrame) -> DataFrame:
    """(doc, ordinals, unnumbered): distinct ordinals in order, and whether there are rows without one."""
    return df.groupBy("doc").agg(F.sort_array(F.collect_set("ordinal")).alias("ordinals"), F.max(F.col("ordinal").isNull()).alias("unnumbered"))


def delete_tail(df: DataFrame, keep: DataFrame) -> DataFrame:
    """df without the chunks whose ordinal reaches the document's number in keep (doc, chunks); other documents stay."""
    return df.join(keep, "doc", "left").filter(F.col("chunks").isNull() | F.col("ordinal").isNull() | (F.col("ordinal") < F.col("chunks"))).drop("chunks")


def payload_refresh(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc, action): refresh where the stored ordinals are exactly 0 to chunks - 1, else defer to a full rebuild. planned: (doc, chunks)."""
    own = stored.groupBy("doc").agg(F.count("ordinal").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_if(F.col("ordinal").isNull()).alias("nulls"))
    whole = (F.col("nulls") == 0) & (F.col("d") == F.col("chunks")) & (F.col("lo") == 0) & (F.col("hi") == F.col("chunks") - 1)
    return planned.join(own, "doc", "left").select("doc", F.when(F.coalesce(whole, F.lit(False)), "refresh").otherwise("defer").alias("action"))


def all_exist(df: DataFrame, wanted: DataFrame, key: str) -> bool:
    return wanted.join(df.select(key), key, "left_anti").isEmpty()


def adopt_vectors(chunks: DataFrame, donors: DataFrame, sparse_required: bool = False) -> DataFrame:
    """chunks (id, content) with the dense (and sparse) vector of the first donor by rank whose row has the same id and content; null for the others.

    donors: (id, rank, content, dense, sparse). A donor without a vector, or with other content, is a miss.
    """
    usable = donors.filter(F.col("dense").isNotNull() & (F.col("sparse").isNotNull() if sparse_required else F.lit(True)))
    offers = usable.select("id", F.col("content").alias("_theirs"), F.col("rank").alias("donor"), "dense", "sparse")
    hits = chunks.select("id", "content").join(offers, "id").filter(F.col("content").eqNullSafe(F.col("_theirs"))).drop("content", "_theirs")
    return chunks.join(latest(hits, ["id"], [F.col("donor")]), "id", "left")


def reuse_rate(adopted: DataFrame, per_chunk_seconds: float | None = None) -> DataFrame:
    """hits, misses, hit_rate and saved_seconds (0.02 a hit where the cost isn't known)."""
    hit = F.count("dense")
    return adopted.agg(hit.alias("hits"), (F.count("*") - hit).alias("misses"), (hit / F.when(F.count("*") > 0, F.count("*"))).alias("hit_rate"), (hit * (per_chunk_seconds or 0.02)).alias("saved_seconds"))


def difference(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, change): new, deleted or candidate, by what is there now and before."""
    a, b = now.select(key).distinct().withColumn("_a", F.lit(True)), before.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").otherwise("candidate").alias("change"))


def obsolete(prior: DataFrame, published: DataFrame) -> DataFrame:
    """Chunks (path, id) of earlier versions that aren't published."""
    return prior.join(published.select("id"), "id", "left_anti")


def rollback(current: DataFrame, existing: DataFrame, protected: DataFrame) -> DataFrame:
    """Ids that a failed run added: neither there before nor protected."""
    return current.select("id").subtract(existing.select("id")).subtract(protected.select("id"))


def merge_observations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pending changes by (root, path): first seen earliest, kinds united, the rest from the latest. Both: (root, path, first_at, latest_at, kinds)."""
    both = current.unionByName(incoming)
    return both.groupBy("root", "path").agg(F.min("first_at").alias("first_at"), F.max("latest_at").alias("latest_at"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))


def restore_captured(captured: DataFrame, pending: DataFrame) -> DataFrame:
    """Captured and pending rows by path; a pending one wins."""
    return captured.join(pending.select("path"), "path", "left_anti").unionByName(pending)


def audit(stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, verdict): matched, incompatible (another digest), extra (no evidence), foreign (another owner) or missing. stored: (id, owner, digest), evidence: (id, digest); owner true is ours."""
    joined = stored.join(evidence.select("id", F.col("digest").alias("expected")), "id", "full_outer")
    verdict = F.when(F.col("owner").isNull(), "missing").when(~F.col("owner"), "foreign").when(F.col("expected").isNull(), "extra").when(F.col("expected") == F.col("digest"), "matched").otherwise("incompatible")
    return joined.select("id", verdict.alias("verdict"))


def audit_result(verdicts: DataFrame) -> DataFrame:
    """Counts by verdict, and whether all match."""
    named = {v: F.count_if(F.col("verdict") == v) for v in ("matched", "extra", "foreign", "incompatible", "missing")}
    return verdicts.agg(*(c.alias(v) for v, c in named.items()), F.when(F.count_if(F.col("verdict") != "matched") == 0, "consistent").otherwise("drift").alias("result"))


# Versions


def or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A catalog table, or no rows where it isn't there; reading never creates it."""
    return spark.read.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """A folder with all that is in it."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def archive(df: DataFrame, path: str, proven_rows: int) -> dict:
    """A copy with a manifest, refused where the live rows aren't those proven."""
    live = df.count()
    if live != proven_rows:
        raise ValueError(f"{live} rows are live, {proven_rows} are proven")
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    manifest = {"rows": live, "digest": str(digest(df))}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str) -> DataFrame:
    """An archive's rows, checked against its manifest."""
    df, manifest = spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if (df.count(), str(digest(df))) != (manifest["rows"], manifest["digest"]):
        raise ValueError(f"{path} isn't what its manifest says")
    return df


def digest(df: DataFrame) -> int | None:
    """A sum of row hashes: equal for equal bags of rows."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
