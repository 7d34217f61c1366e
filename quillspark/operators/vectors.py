"""Vectors and retrieval: embedding, filtered exact cosine top-k, approximate top-k, prompt context.

Exact top-k never materialises query x corpus pairs. A few queries, up to a checked number, are shipped to where the corpus lies:
a task keeps k rows per query, and a final window merges the tasks' answers. Many queries search the cells of an index
(``cells``), and only those cells that can hold an answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.config import TOP_K
from quillspark.functions.exprs import py_float_text
from quillspark.operators import cells
from quillspark.session import materialize

HASH_DIMS = 64
# Bytes of which a token consists, and bytes of text that are cut into tokens at once.
IS_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
EMBED_BYTES = 4_000_000
# Queries that are shipped to every task of a scan (a matrix of so many vectors); more search by cells.
FEW_QUERIES = 1024
# Rows that one matrix product of a scan takes.
SCAN_ROWS = 16_384
# Approximate search: wanted recall, rows that it is measured on, codes that are ranked again per answer.
RECALL = 0.98
MEASURED_ROWS = 200
OVERSAMPLE = 4
# Fixed value: the answer when nothing is found.
NO_CONTEXT = "No relevant information found in the knowledge base."


# --- embedding ---------------------------------------------------------------------------
def token_bucket(token: bytes, dims: int) -> int:
    """Bucket of a token: first 32 bits of its md5, mod ``dims`` (same value in any SQL engine with md5)."""
    return int.from_bytes(hashlib.md5(token).digest()[:4], "big") % dims


def bucket_counts(texts: pa.Array, dims: int) -> np.ndarray:
    """Per text the number of its tokens in each bucket. Tokens are ASCII, so the texts are cut as bytes, all at once; a token is
    hashed once however often these texts hold it."""
    n, sizes = len(texts), pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    inside = IS_TOKEN[raw]
    ends = np.cumsum(sizes)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = (ends - sizes)[sizes > 0]
    starts[first] = inside[first]  # a text does not go on with the token of the one before it
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros((n, dims))
    # the bytes of all tokens without those between them, and where each begins there
    data, place = raw[inside], np.cumsum(inside)[at] - 1
    offsets = np.append(place, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    buckets = np.array([token_bucket(t, dims) for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
    row = np.searchsorted(ends, at, side="right")
    return np.bincount(row * dims + buckets, minlength=n * dims).astype(np.float64).reshape(n, dims)


def _densify(dims: int):
    """Arrow-batch helper: lower-case texts -> unit-length dense vectors with numpy, EMBED_BYTES of text at a time (scatter-add +
    row norms). Sums of integer counts are exact, so the result is bit-identical to the same formula in SQL."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def densify(texts: pa.Array) -> pa.Array:
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, EMBED_BYTES)), [0, len(texts)]))
        parts = [np.zeros((0, dims))]
        for a, b in zip(cuts, cuts[1:]):
            mat = bucket_counts(texts.slice(a, b - a), dims)
            norm = np.sqrt((mat * mat).sum(axis=1))[:, None]
            parts.append(np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0))
        flat = np.concatenate(parts).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(flat))

    return densify


def hashed_bow(df: DataFrame, id_col: str, text_col: str, dims: int = HASH_DIMS,
               keep: Sequence[str] = ()) -> DataFrame:
    """Unit-length bag-of-words vectors (``array<double>``) by feature hashing: (id, *keep, embedding).

    One output row per input row, without a shuffle: texts are lower-cased in the JVM inside the row, then an Arrow batch of
    them is cut into tokens ``[a-z0-9]+``, and turned into dense vectors. Rows that share an id stay apart; texts
    without tokens and null texts get the zero vector.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col), *keep, _densify(dims)(text).alias("embedding"))


def embed_batches(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float]]], dims: int,
                  batch_size: int = 50) -> DataFrame:
    """Pluggable embedding model: ``fn(list[str]) -> list[vector]`` applied to Arrow batches of ``batch_size``."""
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                vecs = fn(part[text_col].fillna("").tolist())
                part["embedding"] = [np.asarray(v, dtype=np.float32).tolist() for v in vecs]
                yield part

    return df.mapInPandas(run, schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns (JVM higher-order functions)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.try_divide(dot, na * nb)  # null for a zero vector


def row_key(id_col: str) -> Column:
    """A key per row where ids may repeat, in the order of the ids. Write it before reading it twice."""
    return F.concat(F.col(id_col).cast("string"), F.lit("\x00"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))


# --- exact filtered top-k ----------------------------------------------------------------
def _columns(names: str | Sequence[str] | None) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)


def _scan(corpus: DataFrame, asked: pd.DataFrame, k: int, *, corpus_id: str, corpus_vec: str, filters: Sequence[tuple[str, str]],
          query_type: T.DataType) -> DataFrame:
    """Candidates (query_id, <corpus_id>, similarity) from one pass over the corpus, without a shuffle of it: a task holds the
    queries ``asked`` (query_id, q, filters) and its k best rows of each so far."""
    shipped = corpus.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), cells.unit(cells.matrix(asked["q"])), [asked[q] for _, q in filters]))
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField(corpus_id, corpus.schema[corpus_id].dataType), T.StructField("similarity", T.DoubleType())])
    names = [c for c, _ in filters]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q, q_filters = shipped.value
        best = None
        for pdf in batches:
            for at in range(0, len(pdf), SCAN_ROWS):
                part = pdf.iloc[at : at + SCAN_ROWS]
                i, r, s = cells.best_rows(qid, q, q_filters, part["__id"].to_numpy(), cells.unit(cells.matrix(part["__vec"])), [part[f"__f{n}"] for n in range(len(names))], k)
                found = pd.DataFrame({"query_id": i, corpus_id: r, "similarity": s})
                best = found if best is None else pd.concat([best, found], ignore_index=True)
                best = best.sort_values(["query_id", "similarity", corpus_id], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    rows = corpus.select(F.col(corpus_id).alias("__id"), F.col(corpus_vec).alias("__vec"), *[F.col(c).alias(f"__f{n}") for n, c in enumerate(names)])
    return rows.mapInPandas(run, schema)


def _ranked(scored: DataFrame, corpus_id: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(corpus_id).asc())
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", corpus_id, "similarity", F.col("rank").cast("int").alias("rank")))


def knn_topk(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, *, corpus_id: str, corpus_vec: str = "embedding",
             query_id: str = "query_id", query_vec: str = "query_vec", corpus_filter: str | Sequence[str] | None = None,
             query_filter: str | Sequence[str] | None = None, few: int = FEW_QUERIES, shard_rows: int = cells.SHARD_ROWS,
             query_rows: int = cells.QUERY_ROWS) -> DataFrame:
    """Top-k corpus rows per query by cosine similarity, optionally restricted to corpus rows whose
    ``corpus_filter`` columns equal the query's ``query_filter`` ones (null = no restriction; pre-filter).

    Result: (query_id, <corpus_id>, similarity = round(1 - cosine distance, 4), rank 1..k); ties by
    similarity then id. Up to ``few`` queries the corpus is scanned where it lies; beyond, it is indexed by cells, which are searched
    as far as their bounds allow. Both give the same rows, and neither side has a limit.
    """
    have, want = _columns(corpus_filter), _columns(query_filter)
    first = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("q"), *want).limit(few + 1).toPandas()
    if len(first) <= few:
        found = _scan(corpus, first, k, corpus_id=corpus_id, corpus_vec=corpus_vec, filters=list(zip(have, want)), query_type=queries.schema[query_id].dataType)
    else:
        index = cells.build_cells(corpus, corpus_id, corpus_vec, have)
        found, _ = cells.exact_topk(index, queries, k, query_id, query_vec, have, want, shard_rows, query_rows)
    return _ranked(found, corpus_id, k)


# --- approximate top-k (inverted file of quantised codes + exact re-rank) ----------------------------
def measured_probes(index: cells.Cells, k: int = TOP_K, recall: float = RECALL, rows: int = MEASURED_ROWS) -> int:
    """Nearest cells to search for the wanted recall, measured with ``rows`` rows of the index as queries against the exact answer."""
    sample = materialize(index.rows.where(F.col("cell") != cells.NO_CELL).orderBy(F.xxhash64(F.col(index.id_col), F.lit("probe"))).limit(rows)
                         .select(F.col(index.id_col).alias("query_id"), F.col("vec").alias("q")))
    asked = sample.toPandas()
    corpus = index.rows.select(index.id_col, "vec")
    unpacked = asked.assign(q=[np.frombuffer(v, "<f8") for v in asked["q"]])
    found = _scan(corpus.withColumn("v", _unpack("vec")), unpacked, k, corpus_id=index.id_col, corpus_vec="v", filters=[], query_type=sample.schema["query_id"].dataType)
    return cells.probes_for(index, sample, _ranked(found, index.id_col, k).select("query_id", index.id_col), recall)


def _unpack(c: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def unpack(v: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<f8") for b in v], dtype=object)

    return unpack(F.col(c))


def ann_topk(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, *, corpus_id: str, corpus_vec: str = "embedding",
             query_id: str = "query_id", query_vec: str = "query_vec", index: cells.Cells | None = None, probes: int | None = None,
             oversample: int = OVERSAMPLE) -> DataFrame:
    """Approximate top-k by an inverted file: the nearest ``probes`` cells of every query, as many as the measured recall asks
    for, are compared by codes of a byte per component; the ``oversample`` x k best ones again by exact cosine. Only codes of
    probed cells are moved. Where neighbours do not lie in cells, as in noise, the measured number is large, up to all cells."""
    index = index if index is not None else cells.build_cells(corpus, corpus_id, corpus_vec)
    probes = probes or measured_probes(index, k)
    asked = materialize(cells._asked(queries, query_id, query_vec, ()))
    near, _ = cells.search(index, materialize(cells.wanted_cells(index, asked, probes)), oversample * k, vec="code")
    near = _ranked(near, corpus_id, oversample * k).select("query_id", corpus_id)
    pairs = near.join(index.rows.select(corpus_id, _unpack("vec").alias("__v")), corpus_id).join(asked.select("query_id", _unpack("q").alias("__q")), "query_id")
    exact = F.coalesce(F.round(1.0 - (1.0 - cosine(F.col("__q"), F.col("__v"))), 4), F.lit(0.0))
    return _ranked(pairs.select("query_id", corpus_id, exact.alias("similarity")), corpus_id, k)


# --- prompt context ------------------------------------------------------------------------
def prompt_context(queries: DataFrame, hits: DataFrame, query_id: str = "query_id",
                   type_col: str = "doc_type", text_col: str = "text") -> DataFrame:
    """Per query: ``[Source i | Type: t | Relevance: s]\\n<text>`` blocks in rank order, joined by
    ``\\n\\n---\\n\\n``; queries without hits get the fixed "nothing found" message.
    ``hits`` has (query_id, rank, similarity, type_col, text_col); at most k rows per query are collected."""
    block = F.struct(F.col("rank"), F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | Type: "), F.coalesce(F.col(type_col).cast("string"), F.lit("unknown")),
        F.lit(" | Relevance: "), py_float_text("similarity"), F.lit("]\n"), F.col(text_col)).alias("b"))
    ctx = hits.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda s: s["b"]),
                                                  "\n\n---\n\n").alias("context"))
    return (queries.select(query_id).join(ctx, query_id, "left")
            .withColumn("context", F.coalesce(F.col("context"), F.lit(NO_CONTEXT))))
