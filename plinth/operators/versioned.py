"""Keyed tables whose writes add files: merged when read, committed through a numbered log.

Rows lie in buckets by their key's hash, in base files and in deltas: a commit writes only its own rows (upserts, and
tombstones for deletes), in files of the buckets it touches. A reader scans the base of buckets without deltas as it is; in
the others it takes each key's row from the last commit that has one. Compaction rewrites the buckets whose deltas are
many or large.

The log has a file for each version, which is put in place if it isn't there yet, so that of two writers one comes first.
The other reads what was committed meanwhile: a write that depends on buckets that changed is made anew from the new
snapshot, others are appended. Files that no version names are never read, so a writer that dies leaves nothing behind
that shows; expire() removes them. A stream's batches carry its name and number, and one that is there already isn't
written again.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table where none are given, at least; else as many as shuffle partitions.
LEAST_BUCKETS = 8
#: A version with all that is there stands in the log each so many commits, so that a reader follows few files.
SNAPSHOT_EVERY = 10
#: A bucket is compacted from so many deltas on, or when they have this share of its base's bytes.
MOST_DELTAS, DELTA_SHARE = 8, 0.25
MOST_TRIES = 30
#: A task that sorts rows has so many of them, or such a share of their files' bytes, at any size of the table; the least are not worth a task.
TASK_ROWS, TASK_BYTES, LEAST_ROWS = 1_000_000, 16 << 20, 100_000


class Conflict(RuntimeError):
    """What a write was made from has changed, each time it was tried."""


def _tasks(rows: int, size: int, most_small: int) -> int:
    """Tasks for so many rows, whose files have size bytes: as many as bound each, and else most_small of them that are worth it."""
    return max(1, math.ceil(rows / TASK_ROWS), math.ceil(size / TASK_BYTES), min(most_small, rows // LEAST_ROWS))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether path is now a file with text; false if there is one already. It is written elsewhere first, so that nobody reads half of it."""
    jvm = spark.sparkContext._jvm
    fs, where = _fs(spark, path)
    _, fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(where.getParent())
    out = fs.create(fresh)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the other's file; a link doesn't
            as_path = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(as_path(fs.makeQualified(where).toUri()), as_path(fs.makeQualified(fresh).toUri()))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(context.makeQualified(fresh), context.makeQualified(where), none)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(fresh, False)
    return True


@dataclass
class State:
    """A version. bases and deltas: by bucket, of deltas in the order of their commits; a file set is {folder, files, bytes, rows}."""

    version: int = 0
    schema: dict | None = None
    key: list[str] = field(default_factory=list)
    buckets: int = 0
    bases: dict[str, dict] = field(default_factory=dict)
    deltas: dict[str, list[dict]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    touched: dict[str, int] = field(default_factory=dict)  # the last version that changed a bucket's rows
    note: dict = field(default_factory=dict)  # of the last replacement

    def after(self, record: dict) -> State:
        """The state that a commit's record leads to."""
        if record.get("kind") == "snapshot":
            return State(**record["state"])
        s = State(**json.loads(json.dumps(self.__dict__)))
        s.version = record["version"]
        if record["kind"] == "reset":
            s.bases, s.deltas, s.touched = {}, {}, {}
        for name in ("schema", "key", "buckets"):
            setattr(s, name, record.get(name, getattr(s, name)))
        for bucket, files in record["files"].items():
            if record["kind"] == "delta":
                s.deltas.setdefault(bucket, []).append({**files, "version": s.version})
            else:
                s.bases[bucket] = files
                if record["kind"] == "compact":  # deltas that came meanwhile stay
                    s.deltas[bucket] = [d for d in s.deltas.get(bucket, []) if d["version"] > record["read"]]
                    if not s.deltas[bucket]:
                        del s.deltas[bucket]
            if record["kind"] != "compact":
                s.touched[bucket] = s.version
        if record["kind"] == "replace":
            s.bases = {b: f for b, f in s.bases.items() if b in record["files"]}
            s.deltas, s.touched = {}, {str(b): s.version for b in range(s.buckets)}
            s.note = record.get("note", {})
        s.streams |= record.get("streams", {})
        return s

    def folders(self) -> set[str]:
        return {f["folder"] for f in self.bases.values()} | {d["folder"] for ds in self.deltas.values() for d in ds}

    def depth(self) -> dict[str, tuple[int, float]]:
        """By bucket: deltas, and their bytes as a share of the base's."""
        return {b: (len(ds), sum(d["bytes"] for d in ds) / max(1, self.bases.get(b, {}).get("bytes", 0))) for b, ds in self.deltas.items()}


class VersionedTable:
    """A table below base. Its first write sets columns, key and buckets. Keys are not null; columns that begin with _ are the table's own."""

    def __init__(self, spark: SparkSession, base: str, indexed: list[str] | None = None):
        """indexed: fields (texts, or lists of texts) whose values each commit of this writer lists by file, for reads that hold some of them."""
        self.spark, self.base, self.indexed = spark, base.rstrip("/"), list(indexed or [])

    # Versions

    def _log(self, version: int) -> str:
        return f"{self.base}/log/{version:020d}.json"

    def versions(self) -> list[int]:
        fs, log = _fs(self.spark, f"{self.base}/log")
        if not fs.exists(log):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(log))
        return sorted(int(n.removesuffix(".json")) for n in names if len(n) == 25 and n.endswith(".json"))

    def state(self, version: int | None = None) -> State:
        """The newest version's, or an older one's."""
        there = [v for v in self.versions() if version is None or v <= version]
        if version is not None and (not there or there[-1] != version):
            raise ValueError(f"{self.base} has no version {version}")
        snapshots, _ = _fs(self.spark, f"{self.base}/log")
        out = State()
        for at in reversed([v for v in there if v % SNAPSHOT_EVERY == 0]):
            path = self._log(at).removesuffix(".json") + ".snapshot"
            if snapshots.exists(_fs(self.spark, path)[1]):
                out = State(**json.loads(_read(self.spark, path)))
                break
        for v in there:
            if v > out.version:
                out = out.after(json.loads(_read(self.spark, self._log(v))))
        return out

    def _commit(self, made_from: State, record: dict, reads: set[str] | None) -> State | None:
        """The state with record in it, at the first free version; None if a bucket of reads (None: any) has changed since made_from, or the stream's batch is there."""
        now = made_from
        for _ in range(MOST_TRIES):
            if any(now.streams.get(name, -1) >= n for name, n in record.get("streams", {}).items()):
                return now
            changed = {b for b, v in now.touched.items() if v > made_from.version}
            if now.version > made_from.version and (bool(changed & reads) if reads is not None else True):
                return None
            attempt = {**record, "version": now.version + 1, "at": time.time()}
            if put_if_absent(self.spark, self._log(now.version + 1), json.dumps(attempt)):
                after = now.after(attempt)
                if after.version % SNAPSHOT_EVERY == 0:
                    put_if_absent(self.spark, self._log(after.version).removesuffix(".json") + ".snapshot", json.dumps(after.__dict__))
                return after
            now = self.state()
        raise Conflict(f"{self.base}: no free version after {MOST_TRIES} tries")

    # Files

    def _bucket(self, key: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in key)), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, key: list[str], buckets: int) -> dict[str, dict]:
        """Files by bucket, in a new folder. Rows are put down as they come first, as their number tells how many tasks sort them: of a large bucket some, of small buckets one."""
        folder, staged = uuid.uuid4().hex, uuid.uuid4().hex
        path = f"{self.base}/data/{folder}"
        rows.write.option("compression", "lz4").parquet(f"{self.base}/data/{staged}")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.base}/data/{staged}").withColumn("_b", self._bucket(key, buckets))
        counts = {str(r["_b"]): r["count"] for r in own.groupBy("_b").count().collect()}  # a row a bucket
        fs, where = _fs(self.spark, f"{self.base}/data/{staged}")
        tasks = _tasks(sum(counts.values()), fs.getContentSummary(where).getLength(), buckets)
        parts = math.ceil(tasks / buckets)
        tasks = tasks if parts == 1 else parts * buckets
        part = F.col("_b") * parts + F.pmod(F.xxhash64(F.lit("part"), *(F.col(f"`{k}`") for k in key)), F.lit(parts)).cast("int")
        dealt = own.repartitionById(tasks, F.floor(part.cast("long") * tasks / (parts * buckets)).cast("int"))
        dealt.sortWithinPartitions("_b", *key).write.partitionBy("_b").option("compression", "zstd").parquet(path)
        self._drop({staged})
        fs, where = _fs(self.spark, path)
        out: dict[str, dict] = {}
        found = fs.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            name = f.getPath().getName()
            if name.startswith("part-"):
                bucket = f.getPath().getParent().getName().removeprefix("_b=")
                own = out.setdefault(bucket, {"folder": folder, "files": [], "bytes": 0, "rows": counts[bucket]})
                own["files"].append(name)
                own["bytes"] += f.getLen()
        if self.indexed:
            self._index(path, StructType([f for f in rows.schema.fields if f.name in self.indexed]))
            for own in out.values():
                own["indexed"] = self.indexed
        return out

    def _index(self, path: str, fields: StructType) -> None:
        """(field, value, file) of a folder, a file with its bucket as a task gives its files in all buckets one name, sorted, so that a reader of a few values skips the row groups of others. Nulls have no entry."""
        rows = self.spark.read.parquet(f"{path}/_b=*")
        each = [F.explode(F.filter(F.array(f.name) if f.dataType.simpleString() == "string" else F.col(f.name), lambda v: v.isNotNull())) for f in fields]
        parts = [rows.select(F.lit(f.name).alias("field"), e.alias("value"), F.regexp_extract("_metadata.file_path", "/(_b=[0-9]+/[^/]+)$", 1).alias("file")).distinct() for f, e in zip(fields, each, strict=True)]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        both.repartitionByRange(files, "field", "value").sortWithinPartitions("field", "value").write.option("compression", "zstd").parquet(f"{path}/index")

    def _holding(self, state: State, holding: dict[str, list[str]]) -> set[tuple[str, str]]:
        """(folder, file) of the base files that hold a value of each field; of older indexes and none a file's name is without its bucket."""
        folders = {f["folder"] for f in state.bases.values() if f["files"]}
        plain = {f["folder"] for f in state.bases.values() if f["files"] and not set(holding) <= set(f.get("indexed", []))}
        if not folders - plain:
            return {(f["folder"], n) for f in state.bases.values() for n in f["files"]}
        index = self.spark.read.parquet(*(f"{self.base}/data/{f}/index" for f in sorted(folders - plain)))
        found: set[tuple[str, str]] | None = None
        for name, values in holding.items():
            hit = index.filter((F.col("field") == name) & F.col("value").isin(values)).select(F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1).alias("folder"), "file").distinct()
            own = {(r["folder"], r["file"]) for r in hit.collect()}  # of files, not of rows
            found = own if found is None else found & own
        return (found or set()) | {(f["folder"], n) for f in state.bases.values() if f["folder"] in plain for n in f["files"]}

    def _paths(self, bucket: str, files: dict) -> list[str]:
        return [f"{self.base}/data/{files['folder']}/_b={bucket}/{n}" for n in files["files"]]

    def _scan(self, state: State, paths: list[str], marked: bool) -> DataFrame:
        schema = StructType.fromJson(state.schema)
        if marked:
            schema = StructType([*schema.fields]).add("_gone", "boolean")
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None, keys: list[tuple] | None = None, where: Column | None = None, holding: dict[str, list[str]] | None = None) -> DataFrame | None:
        """The rows of a version; None where there is no table. keys: a few, of which only the buckets are read. holding: by field, values of which a row has one; of files that are indexed by the fields only those that hold one are read, with the deltas of their buckets."""
        state = self.state(version)
        if state.schema is None:
            return None
        only = None
        if keys is not None:
            kinds = StructType([f for k in state.key for f in StructType.fromJson(state.schema).fields if f.name == k])
            wanted = self.spark.createDataFrame([tuple(k) for k in keys], kinds)
            only = {str(r[0]) for r in wanted.select(self._bucket(state.key, state.buckets)).distinct().collect()}
        keep = where
        for name, values in (holding or {}).items():
            listed = StructType.fromJson(state.schema)[name].dataType.simpleString().startswith("array")
            held = F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if listed else F.col(name).isin(values)
            keep = held if keep is None else held & keep
        rows = self.merged(state, only, self._holding(state, holding) if holding else None, keep)
        if keys is not None:
            rows = rows.join(F.broadcast(wanted.distinct()), state.key, "left_semi")  # as many as the caller has named
        return rows if keep is None else rows.filter(keep)

    def merged(self, state: State, only: set[str] | None = None, files: set[tuple[str, str]] | None = None, keep: Column | None = None) -> DataFrame:
        """The rows of state (of some buckets, and of the base of some files). Buckets without deltas are scanned and no more; in the others the last commit with a key wins. keep: of base rows others may be left out, before they are shuffled."""
        there = [b for b in sorted({*state.bases, *state.deltas}) if only is None or b in only]

        def base(b: str) -> list[str]:
            own = state.bases[b]
            return self._paths(b, {**own, "files": [n for n in own["files"] if files is None or {(own["folder"], n), (own["folder"], f"_b={b}/{n}")} & files]})

        plain = self._scan(state, [p for b in there if b in state.bases and b not in state.deltas for p in base(b)], False)
        touched = [b for b in there if b in state.deltas]
        if not touched:
            return plain
        old = self._scan(state, [p for b in touched if b in state.bases for p in base(b)], False)
        old = old if keep is None else old.filter(keep)
        sets = [f for b in touched for f in (*state.deltas[b], *([state.bases[b]] if b in state.bases else []))]
        order = {d["folder"]: d["version"] for b in touched for d in state.deltas[b]}
        delta = self._scan(state, [p for b in touched for d in state.deltas[b] for p in self._paths(b, d)], True)
        seq = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)]
        both = old.select("*", F.lit(False).alias("_gone"), F.lit(0).alias("_seq")).unionByName(delta.select("*", seq.alias("_seq")))
        # Their number is known, so neither what a scan's task holds nor what is coalesced grows with the table: nothing is gathered before the shuffle.
        tasks = _tasks(sum(f.get("rows", 0) for f in sets), sum(f["bytes"] for f in sets), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        last = F.max("_seq").over(Window.partitionBy(*state.key))
        there = both.repartition(tasks, *state.key).withColumn("_last", last).filter("_seq = _last and not _gone")
        return plain.unionByName(there.drop("_gone", "_seq", "_last"))

    # Writes

    def _ready(self, state: State, rows: DataFrame, key: list[str] | None, buckets: int | None) -> tuple[dict, list[str], int]:
        if state.schema is not None:
            return {}, state.key, state.buckets
        if not key:
            raise ValueError(f"{self.base}: the first write names the key")
        n = buckets or max(LEAST_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return {"schema": json.loads(rows.schema.json()), "key": list(key), "buckets": n}, list(key), n

    def change(self, make: Callable[[DataFrame | None], tuple[DataFrame | None, DataFrame | None]], key: list[str] | None = None, buckets: int | None = None, stream: tuple[str, int] | None = None, depends: str = "all") -> State:
        """Commits what make gives for the newest rows: (rows to put in place of those of equal key, keys to delete), either None.

        Rows have one row a key, and deleted keys that are put too stay. depends: on which rows what make gives depends,
        `all`, those of its `own` buckets, or `none`; if one of these buckets changes before the commit, make is called
        again. stream: (name, number) of a batch, which is committed once.
        """
        for _ in range(MOST_TRIES):
            state = self.state()
            if stream and state.streams.get(stream[0], -1) >= stream[1]:
                return state
            puts, gone = make(self.merged(state) if state.schema is not None else None)
            if puts is None and (gone is None or state.schema is None):
                return state
            first, own_key, n = self._ready(state, puts, key, buckets)
            parts = []
            if puts is not None:
                names = [f["name"] for f in (first or {"schema": state.schema})["schema"]["fields"]]
                parts.append(puts.select(*(f"`{c}`" for c in names)).withColumn("_gone", F.lit(False)))
            if gone is not None and state.schema is not None:
                marks = gone.select(*own_key).distinct()
                marks = marks.join(puts.select(*own_key), own_key, "left_anti") if puts is not None else marks
                fields = StructType.fromJson(state.schema).fields
                parts.append(marks.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in own_key else F.lit(None).cast(f.dataType).alias(f.name) for f in fields), F.lit(True).alias("_gone")))
            files = {}
            if parts:
                both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                new = state.schema is None
                files = self._write(both.drop("_gone") if new else both, own_key, n)
            record = {"kind": "delta" if state.schema is not None else "base", "files": files, **first, **({"streams": {stream[0]: stream[1]}} if stream else {})}
            reads = {"all": {str(b) for b in range(n)}, "own": set(files), "none": set()}[depends]
            after = self._commit(state, record, reads if state.schema is not None else None)
            if after is not None:
                return after
            self._drop({f["folder"] for f in files.values()})
        raise Conflict(f"{self.base}: changed {MOST_TRIES} times while a write was made")

    def upsert(self, rows: DataFrame, key: list[str] | None = None, buckets: int | None = None, stream: tuple[str, int] | None = None) -> State:
        """rows (one a key) in place of those of equal key; of two writers the later commit wins."""
        return self.change(lambda _: (rows, None), key, buckets, stream, "none")

    def delete(self, keys: DataFrame) -> State:
        """Without the rows of keys."""
        return self.change(lambda _: (None, keys), depends="none")

    def replace(self, rows: DataFrame, key: list[str] | None = None, buckets: int | None = None, made_from: int | None = None, expected: int | None = None, beside: Callable[[DataFrame], dict] | None = None) -> State:
        """rows as the whole table. made_from: the version that they were made from; Conflict if another has come since. expected: the number of rows; ValueError if others are written, and nothing shows. beside: called with the written rows, for what is kept along with them; what it gives is the version's note."""
        state = self.state()
        first, own_key, n = self._ready(state, rows, key, buckets)
        if not first:
            first = {"schema": json.loads(rows.schema.json())}
        files = self._write(rows, own_key, n)
        written = self._scan(State(schema=first["schema"]), [p for b, f in files.items() for p in self._paths(b, f)], False)
        count = written.count() if expected is not None else None
        if count != expected:
            self._drop({f["folder"] for f in files.values()})
            raise ValueError(f"{self.base}: {count} rows are written, not {expected}")
        note = beside(written) if beside else {}
        base = state if made_from is None else self.state(made_from) if made_from else State()
        after = self._commit(base, {"kind": "replace", "files": files, "note": note, **first}, set() if made_from is None else None)
        if after is None:
            self._drop({f["folder"] for f in files.values()})
            raise Conflict(f"{self.base}: version {base.version} isn't the newest")
        return after

    def compact(self, most_deltas: int = MOST_DELTAS, share: float = DELTA_SHARE) -> State:
        """New base files for the buckets with most_deltas deltas, or deltas of that share of their base's bytes. Writers go on meanwhile: their deltas stay."""
        state = self.state()
        deep = {b for b, (n, part) in state.depth().items() if n >= most_deltas or part >= share}
        if not deep:
            return state
        files = self._write(self.merged(state, deep), state.key, state.buckets)
        record = {"kind": "compact", "read": state.version, "files": {b: files.get(b, {"folder": "", "files": [], "bytes": 0}) for b in deep}}
        for _ in range(MOST_TRIES):
            now = self.state()
            if any(now.bases.get(b) != state.bases.get(b) for b in deep):
                self._drop({f["folder"] for f in files.values()})
                return now  # another compaction or a replacement came first
            after = self._commit(now, record, None)
            if after is not None:
                return after
        raise Conflict(f"{self.base}: changed {MOST_TRIES} times while it was compacted")

    def reset(self) -> State:
        """No rows, columns and streams kept."""
        state = self.state()
        return state if state.schema is None else self._commit(state, {"kind": "reset", "files": {}}, set())

    def _drop(self, folders: set[str]) -> None:
        for f in folders:
            fs, where = _fs(self.spark, f"{self.base}/data/{f}")
            fs.delete(where, True)

    def expire(self, keep: int = 1, grace_seconds: float = 3600.0) -> set[str]:
        """Removes the folders that the last keep versions don't name, unless they are younger than grace_seconds and so may belong to a write under way. Versions before those can't be read any more."""
        fs, data = _fs(self.spark, f"{self.base}/data")
        there = self.versions()
        if not there or not fs.exists(data):
            return set()
        named = set().union(*(self.state(v).folders() for v in there[-keep:]))
        oldest = (time.time() - grace_seconds) * 1000
        gone = {s.getPath().getName() for s in fs.listStatus(data) if s.getModificationTime() <= oldest} - named
        self._drop(gone)
        return gone
