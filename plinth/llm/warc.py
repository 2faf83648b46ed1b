"""WARC archives without repeated payloads: revisit resolution by payload digest.

Only headers (id, digest, length) are shuffled by digest, to find its first page, to which revisits are joined by salted
digests, so that a payload with many copies is spread. Each file begins with a warcinfo record; each record is a gzip member
of its own. Files are written by Spark's text writer, so any file system that Spark knows will do: a member ends with the
highest byte of its size, which is zero under 16 MB, and that byte is the writer's line separator; a larger record is
followed by an empty member. They are read back as files and parsed by Content-Length.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

EOL = "\r\n"
#: Bytes of payload for one archive, about. A file is read back whole by one task.
ARCHIVE_BYTES = 24 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hexed: str) -> str:
    return base64.b32encode(binascii.unhexlify(hexed)).decode()


#: Parts that a digest's headers are spread over where revisits meet their response.
SALTS = 16
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of addresses


def record_id(page: str | None, digest: str, number: int = 0) -> str:
    """The same for the same page, payload and number; number tells rows that repeat apart."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{digest}:{number}')}>"


def _headed(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None = None) -> DataFrame:
    """id, url, payload (binary), digest, bytes: what is read of pages, under names of its own."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")) if url_col else F.lit("")
    return pages.select(F.col(f"`{id_col}`").alias("id"), F.regexp_replace(url, r"[\x00-\x20]", "%20").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, url_col: str | None = None) -> DataFrame:
    """(id, digest, first, first_url), once each: pages whose payload, of at least least_bytes, a page with a smaller id has too; first is the smallest.

    Null payloads are empty. A null id counts as larger than others, and is no first while there is another. Rows that
    repeat the smallest id are no revisits.
    """
    heads = _headed(pages, id_col, payload_col, url_col).select("id", "url", "digest", "bytes").filter(F.col("bytes") >= least_bytes)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    firsts = heads.groupBy("digest").agg(F.count("*").alias("many"), first.alias("f")).filter("many > 1 and f is not null").select("digest", F.col("f.id").alias("first"), F.col("f.url").alias("first_url"))
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = heads.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    return met.filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first", "first_url").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row: a response with its payload, or a revisit of the response with the same payload, which has none. Headers are made anew.

    Ids and addresses may be null. Characters that would end a header line are percent-encoded in addresses. Rows that
    repeat have record ids of their own. Other columns of pages, of any name, are not read. date: of all records.
    """
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length(F.col(f"`{payload_col}`")))).first()[0] or 0
    files = max(1, -(-total // ARCHIVE_BYTES), min(C.shuffle_partitions(spark), total // (4 << 20)))
    own_key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k")
    again = revisits(pages, id_col, payload_col, least_bytes, url_col).select(own_key, "digest", F.col("first").cast("string").alias("first"), "first_url")
    # Payloads go by their page, so that a payload with many copies is spread; a revisit's isn't written.
    resolved = _headed(pages, id_col, payload_col, url_col).select("*", own_key).repartition(files, "k", "digest").join(again, ["k", "digest"], "left")
    names = ["id", "url", "digest", "bytes", "first", "first_url", "payload"]
    shaped = resolved.select(F.col("id").cast("string").alias("id"), "url", "digest", "bytes", "first", "first_url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        info = f"software: plinth{EOL}format: WARC File Format 1.1{EOL}".encode()
        task = f"<urn:uuid:{uuid.uuid5(_NAMES, f'{path}:{TaskContext.get().partitionId()}')}>"
        waiting = [member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", task), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)]
        for b in C.batches_of(batches, 8 << 20):
            for page, url, hexed, n, first, first_url, payload in zip(*(b.column(names.index(c)).to_pylist() for c in names), strict=True):
                digest = base32_of_hex(hexed)
                number = seen[page, digest]
                seen[page, digest] += 1
                head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page, digest, number)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page or "")]
                if first is not None:
                    head += [("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", first), ("WARC-Profile", PROFILE)]
                waiting.append(member([*head, ("Content-Type", "text/html; charset=utf-8")], payload or b""))
            yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], names=["value"])
            waiting = []

    members = shaped.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        if (name := status.getPath().getName()).startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.split(".")[0] + ".warc.gz"))


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is zero."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}"]
    record = (EOL.join(lines) + EOL + EOL).encode() + block + 2 * EOL.encode()
    whole = gzip.compress(record, 6, mtime=0)
    return (whole if not whole[-1] else whole + gzip.compress(b"", mtime=0))[:-1]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield head, block
        at = end + 8 + n


def members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The members of a gzip file, one by one, in time that is linear in its size."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("the last member is cut off")
            parts.append(reader.decompress(view[at : at + step]))
            at = min(at + step, len(view))
        at -= len(reader.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, path: str, id_kind: str = "long") -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null for revisits until resolve_payloads). id_kind: what page_id and refers_to are read as; an empty text is read as null."""
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                rows, size = [], 0
                for head, block in (r for part in (members(data) if name.endswith(".gz") else (data,)) for r in parse_archive(part)):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    again = head["warc-type"] == "revisit"
                    if not again and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{name}: a payload doesn't have its digest")
                    rows.append((head["page-id"] or None, head["warc-target-uri"], head["warc-type"], head.get("refers-to-page-id") or None, digest, None if again else len(block), None if again else block))
                    size += len(block)
                    if len(rows) == 500 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary")
    return rows.withColumns({c: F.col(c).cast(id_kind) for c in ("page_id", "refers_to")})


def resolve_payloads(records: DataFrame, payload: bool = False) -> DataFrame:
    """records whose revisits have their response's payload_bytes (and payload, if asked for). A revisit without its response keeps nulls.

    Lengths meet by salted ids; payloads, which are long, meet once each.
    """
    kept = ["payload_bytes", *["payload"] * payload]
    records = records.select("page_id", "url", "record_type", "refers_to", "payload_digest", *kept)
    firsts = records.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(*(F.first(c).alias(f"_{c}") for c in kept))
    salts = 1 if payload else SALTS
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = records.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(firsts, ["refers_to", "payload_digest", "_salt"], "left")
    return joined.select("page_id", "url", "record_type", "refers_to", "payload_digest", *(F.coalesce(c, f"_{c}").alias(c) for c in kept))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = C.scratch_path(spark, "warc")
    pages = C.table(spark, sf_dir, "pages")
    write_archives(pages, path)
    return resolve_payloads(read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
