"""Change records: their outcomes and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What can become of a path.
OUTCOMES = ("add", "modify", "delete", "rename", "empty", "ignored", "rejected", "noop")


def valid_delta(kind: Column, path: Column, target: Column, digest: Column) -> Column:
    """Whether a change has a known outcome and the columns that it needs: renames alone a target other than the path, additions and modifications a digest."""
    fits = F.when(kind == "rename", target.isNotNull() & (target != path)).otherwise(target.isNull())
    return F.coalesce(kind.isin(*OUTCOMES) & path.isNotNull() & fits & F.when(kind.isin("add", "modify"), digest.isNotNull()).otherwise(True), F.lit(False))
