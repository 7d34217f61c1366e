"""Best-fit packing of token sequences under several capacities at once.

Every document becomes pieces of at most ``capacity`` tokens; pieces share sequences such that tokens,
documents and attention cost (sum of squared lengths) all stay within their capacities.

1. Token ids are computed once per document in Arrow batches; only lengths and checksums are kept, in a
   table in the shared folder.
2. Pieces are dealt by a hash of their id into shards of about ``shard_pieces`` rows (the number of
   shards follows the number of pieces, so a task's memory does not), and each shard is packed on its
   own: longest piece first, into the open sequence that fits best. A shard leaves at most a few
   sequences unfilled, under 0.1% at the default size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, written
from quillspark.llm.tokens import word_encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and the weight of each in the choice of a sequence.

    The defaults of ``documents`` and ``attention`` follow from ``tokens`` and so never bind on their own.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.float64)


def best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; ``lengths`` must not rise.

    A piece costs (length, 1, length squared). Among the open sequences where all three fit, ``norm``
    takes the one whose residual after the piece has the least weighted Euclidean norm, ``dot`` the one
    with the largest weighted dot product of residual and cost (both in shares of the capacity); ties go
    to the sequence opened first. No fit opens a new sequence. A piece that alone breaks a limit gets a
    sequence of its own.
    """
    limits, w = capacity.limits(), np.array(capacity.weights)
    n = len(lengths)
    seq, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    left = np.empty((3, n))  # residuals of the open sequences, in columns
    name = np.empty(n, dtype=np.int64)
    used = np.empty(n, dtype=np.int64)
    n_open = n_seq = 0
    least = lengths.min() if n else 0
    need_least = np.array([least, 1.0, least * least])[:, None]
    for i, length in enumerate(lengths):
        cost = np.array([length, 1.0, float(length) * length])
        room = left[:, :n_open]
        fits = np.flatnonzero((room >= cost[:, None]).all(axis=0))
        if len(fits):
            share = room[:, fits] / limits[:, None]
            need = (cost / limits)[:, None]
            if rule == "norm":
                j = fits[np.argmin((w[:, None] * (share - need) ** 2).sum(axis=0))]
            elif rule == "dot":
                j = fits[np.argmax((w[:, None] * share * need).sum(axis=0))]
            else:
                raise ValueError(f"unknown rule {rule!r}")
        else:
            j, n_open = n_open, n_open + 1
            left[:, j], name[j], used[j] = limits, n_seq, 0
            n_seq += 1
        seq[i], offset[i] = name[j], used[j]
        left[:, j] -= cost
        used[j] += length
        if (left[:, j : j + 1] < need_least).any():  # nothing else fits: close it, keeping the order of opening
            left[:, j : n_open - 1] = left[:, j + 1 : n_open]
            name[j : n_open - 1] = name[j + 1 : n_open]
            used[j : n_open - 1] = used[j + 1 : n_open]
            n_open -= 1
    return seq, offset


def document_pieces(docs: DataFrame, tokenizer_path: str, tokens: int, end_id: int = 0) -> DataFrame:
    """``PIECE_SCHEMA``: the ids of every text, then ``end_id``, cut into pieces of ``tokens`` ids only
    where they are longer. Null and empty texts have the end id alone."""
    bounded_batches(docs.sparkSession)
    encoder = word_encoder(docs.sparkSession, tokenizer_path)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(), 4 * tokens
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                rows += [(doc, at // size, at // 4, min(size, len(ids) - at) // 4, zlib.crc32(ids[at : at + size]))
                         for at in range(0, len(ids), size)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: Capacity, rule: str = "norm", shard_pieces: int = 4096) -> DataFrame:
    """``pieces`` (``PIECE_SCHEMA``) plus sequence_id and offset (gapless from 0 in each sequence).

    Equal pieces are told apart by nothing and may swap places. No rows give no rows.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shards))

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        seq, offset = best_fit(shard["length"].to_numpy(), capacity, rule)
        return shard.assign(sequence_id=(int(shard["shard"].iloc[0]) << 32) + seq, offset=offset).drop(columns="shard")

    # pandas would turn a null id into a float: carry ids as they are and mark nulls apart
    keyed = pieces.select("*", key.alias("shard"), F.col("doc_id").isNull().alias("no_id")).fillna(0, ["doc_id"])
    packed = keyed.groupBy("shard").applyInPandas(pack, f"{PIECE_SCHEMA}, no_id boolean, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), rule: str = "norm",
                   shard_pieces: int = 4096) -> DataFrame:
    """Pack all documents (``doc_id``, ``text``; other columns are not read): one row per piece with
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece with the end id. Very long text: pieces of ``capacity.tokens`` and a
    shorter last one. Repeated rows are packed as often as they come. Ties go to the smaller id, then to
    the sequence opened first. An empty table gives no rows.
    """
    pieces = written(document_pieces(docs, tokenizer_path, capacity.tokens), "pieces")
    return pack_pieces(pieces, capacity, rule, shard_pieces)
