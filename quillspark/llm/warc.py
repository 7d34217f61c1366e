"""WARC archives as a chunked record table.

Writing: every row is a record; of records with equal payloads one is a response and the others revisit it. Payloads
travel as (record, chunk number) rows of bounded size in order, and a task appends them to one compressed
archive in the shared folder. Reading: a task streams an archive and yields chunk rows with the digest carried on from
chunk to chunk, so neither side holds a whole record in Python; the last chunk of a record has its size and digest.

Only archives that a finished task reported (the manifest, itself a table in the shared folder) are read: what a
lost or repeated attempt left behind is ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, written
from quillspark.session import checkpoint_dir

CHUNK_BYTES = 64 << 10
#: Of compression, a gzip member for each record.
LEVEL = 5
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 0
BATCH_BYTES = 8 << 20

# Fixed values of the WARC 1.1 and HTTP formats.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END = b"\r\n\r\n"

CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean, intact boolean"


def open_file(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, sha1: str, copy: int) -> str:
    """Digest and copy tell rows apart that repeat a page_id."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{sha1}:{copy}>"


def page_of(record: str) -> int | None:
    name = record.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def head(kind: str, record: str, length: int, **more: str | None) -> bytes:
    """Header block of a record; fields that are None are left out."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record, "WARC-Date": "2000-01-01T00:00:00Z"}
    fields |= {k.replace("_", "-"): v for k, v in more.items() if v is not None}
    fields["Content-Length"] = str(length)
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, sha1, size, copy, revisit, first): whether a row revisits another record, and the
    page_id of that one: of equal payloads the one with the largest page_id is the response, of rows that share it
    the first (``copy`` 1).

    Digests are compared without the payloads; these are shuffled once, by page, to meet what was found. Payload groups
    are combined before the shuffle: one that a third of the rows share is one row per task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    keys = rows.select("page", "page_id", "sha1", "size")
    last = keys.groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    last = last.where((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("sha1", "size", "first")
    shared = keys.distinct().join(last, ["sha1", "size"]).select("page", "sha1", "first", F.lit(True).alias("shared"))
    copy = F.row_number().over(Window.partitionBy("page", "sha1").orderBy("size"))
    both = rows.join(shared, ["page", "sha1"], "left").withColumn("copy", copy)
    own = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    return both.withColumn("revisit", F.coalesce("shared", F.lit(False)) & ~own)


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write all pages (page_id, url, html) and return the manifest: (archive, records, bytes).

    A task writes one archive, a gzip member per record; archives are as many as the shuffle by page has partitions (by
    bytes, as AQE sets them). The chunks of a record follow one another within the task.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = with_types(pages, least_bytes)
    body = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(body / chunk_bytes).cast("int") - 1, F.lit(0)))))
    piece = F.when(~F.col("revisit"), F.expr(f"substring(payload, chunk * {chunk_bytes} + 1, {chunk_bytes})"))
    chunks = chunks.select("page_id", "copy", F.when(F.col("chunk") == 0, F.col("url")).alias("url"), "sha1", "size", "chunk",
                           piece.alias("data"), "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        fs, path = open_file(name)
        out, gz, records, size = None, None, 0, 0

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            out.write(data)

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if out is None:
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                        put(gzip.compress(head("warcinfo", f"<urn:x-archive:{uuid.uuid4()}>", 0) + END))
                    else:
                        put(gz.compress(END) + gz.flush())
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    records += 1
                    url = None if r["url"] is None else quote(r["url"], safe="!#$%&'()*+,/:;=?@[]~")
                    common = {"WARC_Target_URI": url, "WARC_Payload_Digest": "sha1:" + base32(r["sha1"])}
                    own = record_id(r["page_id"], r["sha1"], r["copy"])
                    if r["data"] is None:
                        put(gz.compress(head("revisit", own, 0, **common, WARC_Profile=PROFILE, WARC_Payload_Length=str(r["size"]),
                                             WARC_Refers_To=record_id(r["first"], r["sha1"], 1))))
                    else:
                        http = (HTTP % r["size"]).encode()
                        put(gz.compress(head("response", own, len(http) + r["size"], **common, Content_Type="application/http;msgtype=response") + http))
                if r["data"]:
                    put(gz.compress(r["data"]))
        if out is not None:
            put(gz.compress(END) + gz.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": records, "bytes": size}])

    return written(chunks.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def parse(file, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of all responses and revisits of an open archive."""
    while True:
        line = file.readline()
        if not line:
            return
        if line != VERSION:
            raise ValueError(f"no record where one should start: {line[:40]!r}")
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        left = int(fields["content-length"])
        kind = fields["warc-type"]
        if kind == "warcinfo":
            file.read(left)
        else:
            row = {"record_id": fields["warc-record-id"], "page_id": page_of(fields["warc-record-id"]), "record_type": kind}
            told = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "revisit":
                yield row | {"refers_to": page_of(fields["warc-refers-to"]), "chunk": 0, "data": None,
                             "bytes_so_far": int(fields["warc-payload-length"]), "digest_so_far": told, "last": True, "intact": None}
            else:
                while (line := file.readline()) != b"\r\n":  # the HTTP header
                    left -= len(line)
                left -= 2
                sha, chunk, done = hashlib.sha1(), 0, 0
                while True:
                    data = file.read(min(chunk_bytes, left))
                    if left and not data:
                        raise ValueError("an archive ends within a record")
                    sha.update(data)
                    left, done = left - len(data), done + len(data)
                    digest = base64.b32encode(sha.copy().digest()).decode()
                    yield row | {"refers_to": None, "chunk": chunk, "data": data, "bytes_so_far": done, "digest_so_far": digest,
                                 "last": not left, "intact": None if left else digest == told}
                    chunk += 1
                    if not left:
                        break
        if file.read(4) != END:
            raise ValueError("a record does not end where it should")


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table (``CHUNKS``) of the archives: per record its chunks in order with bytes and
    SHA-1 (base32) so far; ``last`` marks the row whose figures are those of the full payload, ``intact`` says there
    whether the digest is that of the record's header. A revisit is one row without data."""
    kinds = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("chunk", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
                       ("last", pa.bool_()), ("intact", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_file(name)
                with fs.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as file:
                    rows, size = [], 0
                    for row in parse(file, chunk_bytes):
                        size += len(row["data"] or b"") + 300
                        rows.append(row if with_data else row | {"data": None})
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n, "archive").mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC archives, read them back, and return one row per record: page_id,
    payload_bytes, payload_digest, record_type, refers_to, intact.

    Null html is an empty payload. Of rows with equal payloads one is the response, repeated rows included; the
    others refer to its page_id. A null page_id is smaller than any other. Urls may be null or hold any character.
    Other columns are not read. An empty table gives no rows.
    """
    r = read_archives(write_archives(pages), with_data=False).where("last")
    return r.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
                    "record_type", "refers_to", "intact")
