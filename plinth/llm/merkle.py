"""Merkle manifest of a table: a hash tree for each group of rows, and one over the groups' subroots.

Rows get their place in their group by row_number within sorted ranges and the counts of the ranges before, so that a group
of any size is numbered by many tasks. Each level is a table: a node's parent is its index divided by the fanout, and the
sorted digests of a parent's children, fanout at most, are hashed into it. Paths go down again level by level: each node
joins its parent's row and puts its siblings before the parent's path, so that a level's rows move once, and the leaves
meet full paths only in the last join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: `-` for null, else its number of UTF-8 bytes, `:` and itself (numbers as decimals)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path (left and right siblings, level by level) give."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def siblings(path: Column) -> Column:
    """The digests of a path in its order, as one string."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with idx (from 0, by order within key) and n (rows of the key). key isn't null; rows that agree in order change places freely."""
    parts = C.shuffle_partitions(rows.sparkSession)
    dealt = C.materialize(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(key)  # a row for each range that has rows of the key
    before = counts.select(key, "_part", (F.sum("_n").over(by.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("n"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, [key, "_part"]).withColumn("idx", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels over leaves (tree, idx, n, digest): (tree, idx, n, children, digest), up to a node for each tree. n: the tree's nodes in that level. A tree of one leaf has no parents."""
    out: list[DataFrame] = []
    below = leaves
    most = below.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = below.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).cast("long").alias("idx"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        hashed = runs.select("tree", "idx", F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("run.digest").alias("children"))
        below = C.materialize(hashed.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "level")
        out.append(below)
        most = -(-most // fanout)
    return out


def tops(leaves: DataFrame, over: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's top."""
    out = leaves.filter("n = 1").select("tree", "digest")
    for level in over:
        out = out.unionByName(level.filter("n = 1").select("tree", "digest"))
    return out


def paths(leaves: DataFrame, over: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """leaves with the columns of above, and path: their siblings up to the tree's top, and then above's path. above: (tree, path, ...), a row a tree."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    place = F.col("idx") % fanout
    step = F.struct(F.array_join(F.slice("_run", F.lit(1), place.cast("int")), "").alias("left"), F.array_join(F.slice("_run", (place + 2).cast("int"), F.lit(fanout)), "").alias("right"))
    parents: DataFrame | None = None
    for level in [*reversed(over), leaves]:
        out = level.filter("n = 1").join(above, "tree")
        if parents is not None:
            up = parents.select("tree", F.col("idx").alias("_up"), F.col("children").alias("_run"), F.col("path").alias("_path"), *more)
            met = level.filter("n > 1").withColumn("_up", F.floor(F.col("idx") / fanout).cast("long")).join(up, ["tree", "_up"])
            out = out.unionByName(met.withColumn("path", F.concat(F.array(step), "_path")).select(out.columns))
        parents = out
    return parents


@dataclass
class Manifest:
    """leaves: (id, tree, idx, n, digest, and kept columns); groups: (tree, key); levels and top: the nodes over leaves and over subroots; root: None for an empty table."""

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    fanout: int

    def proofs(self) -> DataFrame:
        """leaves with subroot and path, from a leaf's own siblings up to those of its subroot."""
        none = F.lit(None).cast(_STEP)
        spark = self.leaves.sparkSession
        over = spark.range(1).select(F.col("id").alias("tree"), F.coalesce(none, F.array().cast(_STEP)).alias("path"))
        heads = paths(self.subroots.select("tree", "idx", "n", "digest", "group"), self.top, over, self.fanout)
        above = C.materialize(heads.select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot")), "heads")
        return paths(self.leaves, self.levels, above, self.fanout)

    def nodes(self) -> DataFrame:
        """(kind, level, tree, idx, digest) of all nodes, to be stored as the table's manifest. kind: group or top."""
        columns = [F.col("tree"), F.col("idx"), F.col("digest")]
        every = [("group", 0, self.leaves), *(("group", i + 1, x) for i, x in enumerate(self.levels)), ("top", 0, self.subroots), *(("top", i + 1, x) for i, x in enumerate(self.top))]
        out = None
        for kind, level, rows in every:
            part = rows.select(F.lit(kind).alias("kind"), F.lit(level).alias("level"), *columns)
            out = part if out is None else out.unionByName(part)
        return out


def build(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: list[str] | None = None, fanout: int = FANOUT, kept: dict[str, Column] | None = None) -> Manifest:
    """Each row is a leaf, the hash of its fields (nulls and empty texts differ), at its place by id_col in its group; subroots go by group (null first, then by UTF-8 bytes).

    Rows that share an id lie in the order of their hashes; a null id comes first. Repeated rows are leaves each. kept:
    more columns for the leaves, by name. Other columns of rows aren't read. An empty table has no root.
    """
    fields = fields or FIELDS
    hashed = rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("key"), digest(*(field(F.col(f"`{c}`")) for c in fields)).alias("digest"), *(v.alias(k) for k, v in (kept or {}).items()))
    hashed = C.materialize(hashed, "hashed")  # else the ranges' sample hashes all texts once more
    placed = numbered(hashed, "key", ["id", "digest"])
    groups = C.materialize(numbered(hashed.select("key").distinct().withColumn("all", F.lit(0)), "all", ["key"]).select(F.col("idx").alias("tree"), "key"), "groups")
    leaves = C.materialize(placed.join(groups, "key").drop("key"), "leaves")
    over = levels(leaves, fanout)
    count = groups.count()
    subroots = tops(leaves, over).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "digest", F.col("tree").alias("group"))
    subroots = C.materialize(subroots, "subroots")
    top = levels(subroots, fanout)
    last = (top[-1] if top else subroots).select("digest").first()
    return Manifest(leaves, groups, over, subroots, top, last["digest"] if last else None, fanout)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Documents whose id has an even crc32 are tampered with: their text loses its line ends."""
    return tamper_check(C.table(spark, sf_dir, "documents"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The digest columns of op11_merkle_manifest for docs."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS))
    manifest = build(docs, kept={"tampered": tampered})
    root = F.lit(manifest.root).cast("string")
    proved = manifest.proofs().select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
