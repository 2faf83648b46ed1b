"""Passages and lines of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_passages(passages: Column, content: Column) -> Column:
    """Texts of passages (start, end) within content; those with offsets outside it or without length are left out."""
    good = F.filter(passages, lambda p: (p["start"] >= 0) & (p["start"] < p["end"]) & (p["end"] <= F.length(content)))
    return F.transform(good, lambda p: F.substring(content, p["start"] + 1, p["end"] - p["start"]))


def line_at(text: Column, offset: Column, first: int = 1) -> Column:
    """The line of the character at offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1)) + (first - 1)
