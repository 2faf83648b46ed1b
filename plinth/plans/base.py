"""Tables and literal rows for queries, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Collects the queries of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what reads it more than once doesn't run it again."""
    from plinth.sources.files import scratch

    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_sql(columns: list[str], rows: list[tuple]) -> str:
    """A parenthesised VALUES query for DuckDB."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x!r}::double"
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"(select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({', '.join(columns)}))"


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Record types in the order in which documents are dealt to them.
TYPES = ("adr", "audit", "exec", "plan", "reference", "research")
STATUSES = ("accepted", "proposed", "superseded", "", "deprecated")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as records: id, doc_type, status, path, tags, title and content."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 6 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(F.col("doc_id") / 6) % 5 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), kind.alias("doc_type"), F.when(kind == "adr", state).otherwise("").alias("status"), "lang", "source",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.array(F.concat(F.lit("#"), kind), F.concat(F.lit("#"), F.col("source")), F.col("lang")).alias("tags"),
        F.col("text").alias("content"),
    )


VAULT_SQL = """(select *, case when doc_type = 'adr' then state else '' end as status from (
  select doc_id as id, ['adr','audit','exec','plan','reference','research'][(doc_id % 6 + 1)::int] as doc_type,
    ['accepted','proposed','superseded','','deprecated'][((doc_id // 6) % 5 + 1)::int] as state, lang, source,
    source || '/' || lang || '/' || doc_id || '.md' as path,
    ['#' || ['adr','audit','exec','plan','reference','research'][(doc_id % 6 + 1)::int], '#' || source, lang] as tags, text as content
  from documents))"""
