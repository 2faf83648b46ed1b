"""Table functions for SQL: chunkers and packers as Python UDTFs, to be used by LATERAL or over a partitioned table.

    register(spark)
    spark.sql("select d.id, c.* from docs d, lateral split_text(d.text, 512, 'text') c")
    spark.sql("select * from greedy_segments(64, 8388608, table(files) partition by grp order by item)")
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from plinth.functions import chunk as K

_PASSAGES = "array<struct<start:int,end:int,line_start:int,line_end:int,section:string>>"


@udtf(returnType="ordinal int, start int, line_start int, content string")
class SplitText:
    """Chunks of at most size characters where separators of the language allow, with their place and first line. Null: none."""

    def eval(self, text: str, size: int, language: str) -> Iterator[tuple[Any, ...]]:
        pieces = K.split_text(text or "", size, 0, language)
        at, line = 0, 1
        for i, (piece, start) in enumerate(zip(pieces, K.offsets_of(text or "", pieces), strict=True)):
            line += (text or "").count("\n", at, start)
            at = start
            yield i, start, line, piece


@udtf(returnType=f"ordinal int, content string, line_start int, line_end int, section string, passages {_PASSAGES}")
class SplitRecord:
    """Chunks of a Markdown record's body with lines, section and passages. Null is one empty chunk."""

    def eval(self, body: str, size: int) -> Iterator[tuple[Any, ...]]:
        for c in K.split_record(body or "", size):
            yield c["ordinal"], c["content"], c["line_start"], c["line_end"], c["section"], c["passages"]


@udtf(returnType="id string, content string, line_start int, line_end int, node_type string, function_name string, class_name string")
class SplitCode:
    """Chunks of a source file, by its definitions where the language's structure can be read."""

    def eval(self, source: str, path: str, language: str) -> Iterator[tuple[Any, ...]]:
        for c in K.code_chunks(source or "", path, language or "text"):
            yield c["id"], c["content"], c["line_start"], c["line_end"], c["node_type"], c["function_name"], c["class_name"]


@udtf(returnType="grp string, item string, size bigint, segment int")
class GreedySegments:
    """Segments of a group's rows (group, size, item), in the order that the call asks for: one is closed before the row that would overrun it."""

    def __init__(self) -> None:
        self.n = self.total = self.segment = 0

    def eval(self, most_items: int, most_size: int, row: Row) -> Iterator[tuple[Any, ...]]:
        group, size, item = row[0], row[1], row[2]
        if self.n and (self.n == most_items or self.total + size > most_size):
            self.n, self.total, self.segment = 0, 0, self.segment + 1
        self.n, self.total = self.n + 1, self.total + size
        yield None if group is None else str(group), None if item is None else str(item), size, self.segment


def register(spark: SparkSession) -> None:
    for name, function in (("split_text", SplitText), ("split_record", SplitRecord), ("split_code", SplitCode), ("greedy_segments", GreedySegments)):
        spark.udtf.register(name, function)
