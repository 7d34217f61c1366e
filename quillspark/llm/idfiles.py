"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file is a run of zstandard frames of at most ``FRAME_BYTES`` of ids (little-endian unsigned 32-bit), each with its own content
checksum; then two skippable frames, the document index (zstandard of: per document a null flag, its id and its number of ids) and
the seek table of the public seekable format (per frame its compressed size, its size and the low 32 bits of the XXH64 of its ids).
Any zstandard reader gets the ids of the whole file; this one reads the tail first and then only the frames that the wanted
documents lie in. A document starts a new frame when it does not fit in the open one, so most lie in one frame.

Writing: one shuffle deals the texts by ranges of doc_id; a task encodes its texts in order and writes files of bounded size. The
manifest, a table in the shared folder, names the files that finished tasks wrote, in order, with the ids before each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, written
from quillspark.llm.tokens import byte_encoder
from quillspark.session import checkpoint_dir

FRAME_BYTES = 256 << 10
#: A file ends when it holds so many bytes of ids or so many documents.
FILE_BYTES = 256 << 20
FILE_DOCS = 500_000
LEVEL = 3

# Fixed values of the zstandard seekable format.
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
INDEX = 0x184D2A50

MANIFEST = "file string, task int, number int, documents long, tokens long"
DOCUMENTS = "file string, position int, doc_id long, at long, n_tokens long"


def open_fs(name: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return pyarrow.fs.FileSystem.from_uri("file://" + name[5:] if name.startswith("file:") and "://" not in name else name)


class FrameWriter:
    """Appends documents to one open file."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.open, self.size, self.frames, self.docs = [], 0, [], []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids) // 4))
        self.bytes += len(ids)
        if self.open and self.size + len(ids) > self.frame_bytes:
            self.flush()
        view = memoryview(ids)
        while len(view) > self.frame_bytes:
            self.open, view = [view[: self.frame_bytes]], view[self.frame_bytes :]
            self.flush()
        self.open.append(view)
        self.size += len(view)

    def flush(self) -> None:
        data = b"".join(self.open)
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self.flush()
        docs = np.array(self.docs, dtype=[("null", "u1"), ("id", "<i8"), ("n", "<u8")])
        index = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(docs.tobytes())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Random access to one file: the tail first, then the frames asked for, each checked against the seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        frames, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * frames
        if struct.unpack("<II", self.at(start - 8, 8)) != (SEEK_TABLE, 12 * frames + 9):
            raise ValueError("the seek table is not a skippable frame of its length")
        table = np.frombuffer(self.at(start, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.sums = np.r_[0, np.cumsum(table[:, 0])], table[:, 2]
        self.plain = np.r_[0, np.cumsum(table[:, 1])]
        self.tail = (int(self.packed[-1]), start - 8)
        self.frame, self.data, self.frames_read = -1, b"", 0
        self.zstd = zstandard.ZstdDecompressor()

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Null flags, doc_ids and numbers of ids of all documents, in order; no frame of ids is read."""
        start, end = self.tail
        if struct.unpack("<II", self.at(start, 8)) != (INDEX, end - start - 8):
            raise ValueError("the document index is not a skippable frame of its length")
        docs = np.frombuffer(self.zstd.decompress(self.at(start + 8, end - start - 8)), dtype=[("null", "u1"), ("id", "<i8"), ("n", "<u8")])
        return docs["null"].astype(bool), docs["id"], docs["n"].astype(np.int64)

    def pieces(self, start: int, n: int) -> Iterator[bytes]:
        """The bytes of ``n`` ids from the ``start``-th of the file on, frame by frame."""
        at, end = 4 * start, 4 * (start + n)
        while at < end:
            k = int(np.searchsorted(self.plain, at, side="right")) - 1
            if k != self.frame:
                a, z = int(self.packed[k]), int(self.packed[k + 1])
                self.data = self.zstd.decompress(self.at(a, z - a))
                self.frame, self.frames_read = k, self.frames_read + 1
                if xxhash.xxh64_intdigest(self.data) & 0xFFFFFFFF != self.sums[k]:
                    raise ValueError(f"frame {k} does not have its checksum")
            base = int(self.plain[k])
            piece = self.data[at - base : end - base]
            yield piece
            at += len(piece)


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES,
                file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode and write all texts (doc_id, text), an ``end_id`` after each, by rising doc_id; returns the manifest: file, order,
    documents, tokens, start (ids before the file).

    The order is doc_id (nulls first), then a hash of the text, then the place in the input, so that rows which share an id still
    spread over tasks. Running sums go over the files, a few hundred MB each, not over documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    encoder, end = byte_encoder(spark, tokenizer_path), end_id.to_bytes(4, "little")
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number, writer, name = encoder(), TaskContext.get().partitionId(), 0, None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"file": name, "task": task, "number": number, "documents": len(writer.docs), "tokens": writer.bytes // 4}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("task", pa.int32()), ("number", pa.int32()),
                                                                       ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    name = f"{folder}/{task:06d}-{number:04d}-{uuid.uuid4().hex}.ids.zst"
                    fs, path = open_fs(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = FrameWriter(fs.open_output_stream(path, compression=None), frame_bytes)
                writer.add(doc_id, encode(text.as_py()) + end)
                if writer.bytes >= file_bytes or len(writer.docs) >= file_docs:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    files = written(rows.mapInArrow(write, MANIFEST), "id-files")
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _opened(name: str) -> FrameReader:
    fs, path = open_fs(name)
    return FrameReader(fs.open_input_file(path))


def read_all(manifest: DataFrame) -> DataFrame:
    """Per document of all files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A task reads a file frame
    after frame and holds one of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = _opened(name)
                null, ids, n = reader.index()
                at = np.cumsum(n) - n
                crc = np.empty(len(n), np.int64)
                for i in range(len(n)):
                    c = 0
                    for piece in reader.pieces(int(at[i]), int(n[i])):
                        c = zlib.crc32(piece, c)
                    crc[i] = c
                for a in range(0, len(n), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s], mask=null[s]), pa.array(start + at[s]), pa.array(n[s]), pa.array(crc[s])],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_index(manifest: DataFrame) -> DataFrame:
    """``DOCUMENTS``: where each document lies, from the tails of the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                null, ids, n = _opened(name).index()
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(np.arange(len(n), dtype=np.int32)),
                                                  pa.array(ids, mask=null), pa.array(at), pa.array(n)],
                                                 names=["file", "position", "doc_id", "at", "n_tokens"])

    return manifest.select("file").mapInArrow(read, DOCUMENTS)


def read_documents(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, ids, frames_read) of the documents whose doc_id ``wanted`` holds: only the frames that they lie in are
    decompressed; ``frames_read`` counts those of the file up to this document. Ids that no file has give no rows."""
    want = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = index.join(want, "doc_id", "left_semi").repartition("file").sortWithinPartitions("file", "position")
    kinds = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("ids", pa.binary()), ("frames_read", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, reader = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != open_:
                    open_, reader = r["file"], _opened(r["file"])
                ids = b"".join(reader.pieces(r["at"], r["n_tokens"]))
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "position": r["position"], "ids": ids, "frames_read": reader.frames_read}], schema=kinds)

    return rows.mapInArrow(read, "doc_id long, position int, ids binary, frames_read long")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all texts and read the files back: doc_id, start, n_tokens, ids_crc32 per row of ``docs`` (doc_id, text).

    Null and empty texts have the end id alone. Very long texts lie in several frames and are never cut. Null doc_ids come
    first; rows that share an id come in the order of a hash of their text. Other columns are not read. An empty table gives no rows.
    """
    return read_all(write_files(docs, tokenizer_path))
