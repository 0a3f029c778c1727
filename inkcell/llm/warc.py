"""WARC archives as dictionary-compressed Zstandard, and their reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from a bounded
sample of the records; each record after it, a warcinfo first, is a frame of its own, so it can be read
alone. Records with equal payloads are revisits of the one with the largest page id; what is equal is found
by digest, with the groups reduced in each task before they meet.

Archives are written to shared storage under names that depend on the task only, first under a name of the
attempt's own, then renamed, so a repeated attempt leaves one whole file. Null html is an empty payload. Rows
with a null page id are written (and read back with a null id); they are response unless a row with an id has
the same payload. An empty table gives no archive. Repeated ids get a record each.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parallelism, shared_dir

MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 64 << 10
#: Records of the dictionary's sample, and bytes taken of each.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 16 << 10
#: Digests (of 32 bytes) that are broadcast at most.
BROADCAST_ROWS = 500_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(kind: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without the payload whose HTTP head still tells its length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Record-ID", record_id(page_id, url)), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        return record("revisit", http, [*fields, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))])
    return record("response", http + payload, fields)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; of too small a sample, its raw bytes."""
    total = sum(map(len, samples))
    if len(samples) >= 8 and total > 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: null for what is to be a response.

    Only digests and ids meet, to find the payloads that occur again. If these are few enough their digests are
    broadcast, so that pages stay where they are; else pages are dealt out by digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.length("payload") >= least).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    again = materialize(groups.where("n > 1 and last is not null").select("key", "last"), "warc-repeats")
    joined = rows.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "key", "left")
    other = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("last")))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("last")).alias("refers_to"))


def sample(pages: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[bytes]:
    """Records of about ``rows`` pages chosen by a hash of their id, cut to ``size`` bytes. The ids are chosen
    by count first, so tasks send no more than their share."""
    n = pages.count()
    few = pages if n <= rows else pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(rows / n * (1 << 30)) + 1)
    few = few.select("page_id", "url", F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, size).alias("html")).limit(4 * rows)
    return [page_record(r["page_id"], r["url"], r["html"].encode(), None) for r in sorted(few.collect(), key=lambda r: (r["page_id"] is None, r["page_id"], r["url"] or ""))]


def write(pages: DataFrame, uri: str, least: int = 0, level: int = 3) -> list[str]:
    """Write the archives under ``uri``; their URIs."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(train(sample(pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _fs(uri)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.zst"
        own = f"{name}.{task.taskAttemptId()}"
        raw = shared.value
        coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True) if raw else zstandard.ZstdCompressor(level=level)
        n, out = 0, None
        for batch in batches:
            for p, u, body, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(own, compression=None)
                    out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
                    about = b"software: inkcell\r\nformat: WARC File Format 1.1\r\n"
                    out.write(coder.compress(record("warcinfo", about, [("WARC-Record-ID", record_id(None, name.rpartition("/")[2])), ("Content-Type", "application/warc-fields")])))
                out.write(coder.compress(page_record(p, u, body, r)))
                n += 1
        if out is not None:
            out.close()
            fs.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([n], pa.int64())], names=["name", "n"])

    # one row an archive
    done = revisits(pages, least).mapInArrow(run, "name string, n long").where("n > 0").collect()
    return sorted(f"{uri}/{r['name']}" for r in done)


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record, one frame in memory at a time."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        head = f.read(8)
        if len(head) < 8:
            return
        magic, size = struct.unpack("<II", head)
        if magic != MAGIC:
            raise ValueError(f"{uri}: no dictionary frame")
        raw = f.read(size)
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
        rest = b""
        while True:
            unit = coder.decompressobj()
            got: list[bytes] = []
            while not unit.eof:
                if not rest:
                    rest = f.read(1 << 20)
                    if not rest:
                        break
                got.append(unit.decompress(rest))
                rest = unit.unused_data if unit.eof else b""
            if not unit.eof:
                if any(got):
                    raise ValueError(f"{uri}: cut off")
                return
            body = b"".join(got)
            top, _, block = body.partition(b"\r\n\r\n")
            lines = top.decode().split("\r\n")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            yield fields, block[: int(fields["content-length"])]


def read(spark: SparkSession, uris: list[str]) -> DataFrame:
    """READ of every page record. Length and digest of responses are taken from the payload itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in READ.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for fields, block in records(uri):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = fields["warc-payload-digest"].partition(":")[2]
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    if fields["warc-type"] == "response":
                        found = digest(payload)
                        if found != said:
                            raise ValueError(f"{uri}: a payload differs from its digest")
                        rows.append((number("x-page-id"), fields["warc-target-uri"], len(payload), found, "response", None))
                    else:
                        length = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        rows.append((number("x-page-id"), fields["warc-target-uri"], length, said, "revisit", number("x-refers-to-page-id")))
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    if not uris:
        return spark.createDataFrame([], READ)
    names = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(min(len(uris), parallelism(spark) * 4), "uri")
    return names.mapInArrow(run, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", least))
