"""Table schemas, their stamps, and whether a stored table fits."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION, WIDTH, VECTOR = 2, 1024, "dense"
_PASSAGE = "struct<start:int,end:int,line_start:int,line_end:int,section:string>"
_LOCATOR = "locator_kind string, locator_value_int bigint, locator_value_str string, locator_end_int bigint, locator_end_str string"
_VECTORS = "point_id bigint, dense array<float>, sparse map<int,double>"
DDL = {
    "vault_docs": f"doc_id string, chunk_ordinal int, chunk_count int, path string, doc_type string, feature string, date string, tags array<string>, related array<string>, title string, status string, content string, body_line int, line_start int, line_end int, section string, passages array<{_PASSAGE}>, doc_content string, {_VECTORS}",
    "codebase_docs": f"chunk_id string, path string, language string, content string, line_start int, line_end int, node_type string, function_name string, class_name string, source_path string, preprocessor_id string, anchor string, {_LOCATOR}, domain string, {_VECTORS}",
    "document_docs": f"document_id string, source_path string, unit_ordinal int, content_fingerprint string, content string, title string, section string, anchor string, {_LOCATOR}, document_metadata string, unit_metadata string, extractor_id string, extractor_version string, {_VECTORS}",
}


def schema(name: str) -> StructType:
    """Wants a session, as Spark reads it."""
    return StructType.fromDDL(DDL[name])


def stamp(name: str, width: int = WIDTH) -> dict:
    return {"version": VERSION, "width": width, "vector": VECTOR, "schema": hashlib.sha256(DDL[name].encode()).hexdigest()}


def compatible(found: dict | None, known_version: int = VERSION, width: int = WIDTH) -> str:
    """ok, or what doesn't fit: no stamp, a newer version, another width or vector name."""
    if not found:
        return "unstamped"
    if found.get("version", 0) > known_version:
        return "newer"
    return "width" if found.get("width") != width else "vector" if found.get("vector") != VECTOR else "ok"


def conformance(found: dict | None, expected: dict, live_width: int | None) -> str:
    if not found or live_width is None:
        return "unverifiable"
    return "conforming" if found == expected and live_width == expected["width"] else "nonconforming"


def payload_errors(df: DataFrame, name: str) -> DataFrame:
    """(column, problem) of columns that a table's schema has and df lacks, or holds in another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    bad = [(f.name, "missing" if f.name not in have else f"is {have[f.name]}") for f in schema(name) if have.get(f.name) != f.dataType.simpleString()]
    return df.sparkSession.createDataFrame(bad, "column string, problem string")


def epoch(**settings) -> str:
    """Digest of the settings that decide a table's content; another one asks for a rebuild."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


_STAMP = "version int, width int, vector string, schema string"


def stamp_fits(stamp: str) -> Column:
    """compatible() of a column of stamps as JSON."""
    s = F.from_json(stamp, _STAMP)
    return F.when(F.col(stamp).isNull(), "unstamped").when(s["version"] > VERSION, "newer").when(~s["width"].eqNullSafe(F.lit(WIDTH)), "width").when(~s["vector"].eqNullSafe(F.lit(VECTOR)), "vector").otherwise("ok")


def stamp_verdict(stamp: str, expected: dict, live_width: Column) -> Column:
    """conformance() of a column of stamps as JSON, and of the width in use."""
    s = F.from_json(stamp, _STAMP)
    same = live_width == expected["width"]
    for name, value in expected.items():
        same = same & s[name].eqNullSafe(F.lit(value))
    return F.when(F.col(stamp).isNull() | live_width.isNull(), "unverifiable").when(same, "conforming").otherwise("nonconforming")


def kind_fingerprint(kind: Column, budget: Column) -> Column:
    """Digest of the settings that decide a kind's chunks; the budget is one of documents alone."""
    return F.sha2(F.when(kind == "document", F.to_json(F.struct(budget.alias("budget"), kind.alias("kind")))).otherwise(F.to_json(F.struct(kind.alias("kind")))), 256)


def chunk_bytes(columns: list[str], width: int, sparse: str | None = None) -> Column:
    """What a chunk weighs: its texts, four bytes a dense component, sixteen a sparse entry."""
    total = F.lit(4 * width).cast("long")
    for c in columns:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total + F.coalesce(F.size(sparse) * 16, F.lit(0)) if sparse else total
