"""Cells of similar vectors: exact top-k for many queries by metric pruning, and approximate top-k by an inverted file.

Vectors are dealt to the nearest of a bounded number of centres, which spherical k-means learns on a bounded sample by
aggregations. A cell knows its centre and its radius, the widest angle between the centre and a row. Angles obey the triangle
inequality, so no row of a cell is nearer to a query than the angle to the centre less the radius:

* exact: a query first meets its nearest cells, which gives a k-th similarity; then only those cells whose bound can still
  reach it. A row is moved once for each block of queries that wants its cell, and not at all if none does.
* approximate: a query meets its nearest ``probes`` cells only, as codes of a byte per component; the best codes are ranked
  again by the exact cosine. The number of probes follows from the recall measured on a sample of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import materialize

#: Cells grow with the square root of the rows up to this number: their centres are shipped to every task.
MAX_CELLS = 4096
#: Rows of the sample per cell, and rounds of k-means on it.
SAMPLE_PER_CELL = 64
ROUNDS = 5
#: Rows of a part of a cell and queries of a block: one matrix product each.
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
#: Cells that the first round of the exact search reads.
FIRST_PROBES = 2
#: Numbers of a matrix of similarities that are worked on at once (8 bytes each, and a few copies of them).
TILE = 2_000_000
#: Bytes of queries that a batch of wanted cells repeats.
WANTED_BYTES = 8_000_000
#: Similarities are compared with 4 decimals.
ROUNDING = 1e-4
NO_CELL = -1  # zero vectors: similarity 0 to everything


def matrix(vectors: pd.Series, packed: str | None = None) -> np.ndarray:
    """A column of arrays, or of packed numbers of a type, as rows of doubles."""
    if not len(vectors):
        return np.zeros((0, 1))
    if packed is None:
        return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    return np.frombuffer(b"".join(vectors), packed).reshape(len(vectors), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the zero vector stays zero."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def tiles(rows: int, columns: int) -> list[slice]:
    """The rows of a matrix in slices of at most TILE numbers, at least a row each."""
    step = max(1, TILE // max(1, columns))
    return [slice(a, a + step) for a in range(0, rows, step)]


def best_rows(qid: np.ndarray, q: np.ndarray, q_filters: Sequence[pd.Series], rid: np.ndarray, x: np.ndarray,
              filters: Sequence[pd.Series], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the k best rows of every query by (similarity descending, row ascending): matrix
    products of unit vectors, a tile at a time, and a selection in each. A filter value of a query that is null restricts nothing."""
    if not len(qid) or not len(rid):
        return qid[:0], rid[:0], np.zeros(0)
    by = np.argsort(rid, kind="stable")
    ordered, k = np.ascontiguousarray(x[by]), min(k, len(rid))
    codes = [pd.factorize(pd.concat([want, have], ignore_index=True))[0] for want, have in zip(q_filters, filters)]
    parts = []
    for at in tiles(len(qid), len(rid)):
        sims = np.round(1.0 - (1.0 - q[at] @ ordered.T), 4)  # 1 - distance, 4 decimals
        for c in codes:
            mine, theirs = c[: len(qid)][at], c[len(qid) :][by]
            sims[(mine[:, None] != theirs[None, :]) & (mine >= 0)[:, None]] = -np.inf
        kth = np.partition(sims, -k, axis=1)[:, -k]
        qi, ri = np.nonzero((sims >= kth[:, None]) & (sims > -np.inf))
        value = sims[qi, ri]
        order = np.lexsort((ri, -value, qi))
        qi, ri, value = qi[order], ri[order], value[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        parts.append((qid[at][qi[keep]], rid[by[ri[keep]]], value[keep]))
    return tuple(np.concatenate(p) for p in zip(*parts))


@dataclass(frozen=True)
class Cells:
    """An index: ``rows`` (<id>, vec, code, *keep, cell), written; per cell its unit centre, its radius and its number of rows."""

    rows: DataFrame
    id_col: str
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    keep: tuple[str, ...] = ()

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest cosine that a row of each cell can have to each of the unit vectors ``q``."""
        angle = np.arccos(np.clip(q @ self.centres.T, -1.0, 1.0))
        return np.cos(np.maximum(angle - self.radius, 0.0)) + 1e-9


def learn_centres(sample: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means on ``sample`` (vec, packed doubles; h, a hash): the first centres are the vectors with the
    smallest hashes, each round assigns the sample and adds up its cells in Spark. At most ``cells`` vectors reach the driver."""
    start = sample.select("vec", "h").orderBy("h").limit(cells).toPandas()
    centres = np.unique(unit(matrix(start["vec"], "<f8")), axis=0)
    sc = sample.sparkSession.sparkContext

    def assigned(shipped):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = unit(matrix(pdf["vec"], "<f8"))
                cell = np.concatenate([(x[at] @ shipped.value.T).argmax(axis=1) for at in tiles(len(x), len(shipped.value))] or [np.zeros(0, np.int64)])
                sums = np.zeros_like(shipped.value)
                np.add.at(sums, cell, x)
                found = np.unique(cell)
                yield pd.DataFrame({"cell": found, "total": [sums[c].tobytes() for c in found]})
        return run

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = matrix(pdf["total"], "<f8").sum(axis=0)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "total": [total.tobytes()]})

    for _ in range(rounds):
        parts = sample.mapInPandas(assigned(sc.broadcast(centres)), "cell long, total binary")
        sums = parts.groupBy("cell").applyInPandas(added, "cell long, total binary").toPandas()
        centres = centres.copy()
        moved = unit(matrix(sums["total"], "<f8"))
        at, ok = sums["cell"].to_numpy(), moved.any(axis=1)
        centres[at[ok]] = moved[ok]
    return centres


def build_cells(corpus: DataFrame, corpus_id: str, corpus_vec: str, keep: Sequence[str] = (), cells: int | None = None) -> Cells:
    """Index every row of ``corpus`` by its cell. The sample has at most SAMPLE_PER_CELL rows per cell, chosen by a hash of the id."""
    keep = list(dict.fromkeys(keep))

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(a, "<f8").tobytes() for a in v], dtype=object)

    rows = materialize(corpus.select(F.col(corpus_id), packed(F.col(corpus_vec)).alias("vec"), *keep))
    n = rows.count()
    cells = cells or int(min(MAX_CELLS, max(1, np.ceil(np.sqrt(n)))))
    want = cells * SAMPLE_PER_CELL
    hashed = rows.select("vec", F.xxhash64(F.col(corpus_id)).alias("h"))
    share = min(1.0, 1.5 * want / max(n, 1))
    sample = materialize(hashed.where(F.pmod("h", F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).orderBy("h").limit(want))
    centres = learn_centres(sample, cells)
    shipped = corpus.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = unit(matrix(pdf["vec"], "<f8"))
            cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
            for at in tiles(len(x), len(shipped.value)):
                cosine = x[at] @ shipped.value.T
                cell[at], near[at] = cosine.argmax(axis=1), cosine.max(axis=1)
            top = np.abs(x).max(axis=1, keepdims=True)
            code = np.rint(np.divide(x, top, out=np.zeros_like(x), where=top > 0) * 127).astype(np.int8)
            zero = ~x.any(axis=1)
            angle = np.arccos(np.clip(near, -1.0, 1.0))
            yield pdf.assign(code=[c.tobytes() for c in code], cell=np.where(zero, NO_CELL, cell).astype(np.int32), angle=np.where(zero, 0.0, angle))

    dealt = materialize(rows.mapInPandas(assign, schema).repartition("cell"))
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres) + 1, np.int64)
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        sizes[r["cell"]] = r["n"]
        if r["cell"] != NO_CELL:
            radius[r["cell"]] = r["r"]
    return Cells(dealt.drop("angle"), corpus_id, centres, radius, sizes, tuple(keep))


def _asked(queries: DataFrame, query_id: str, query_vec: str, filters: Sequence[str]) -> DataFrame:
    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(a, "<f8").tobytes() for a in v], dtype=object)

    return queries.select(F.col(query_id).alias("query_id"), packed(F.col(query_vec)).alias("q"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(filters)])


def wanted_cells(cells: Cells, asked: DataFrame, probes: int, least: str | None = None) -> DataFrame:
    """(query_id, q, filters..., cell): the nearest ``probes`` cells of every query; with ``least``, a column of similarities, the
    other cells that can hold a row of at least that similarity."""
    shipped = asked.sparkSession.sparkContext.broadcast((cells.centres, cells.radius, cells.sizes))
    out = [c for c in asked.columns if c != least]
    schema = T.StructType([*[asked.schema[c] for c in out], T.StructField("cell", T.IntegerType())])
    index = Cells(None, "", *shipped.value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            if not len(whole) or not index.sizes.any():
                continue
            # a query may want every cell: few queries at a time, and their rows in pieces
            for at in tiles(len(whole), len(index.centres)):
                pdf = whole.iloc[at]
                q = unit(matrix(pdf["q"], "<f8"))
                near = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, :probes]
                chosen = np.zeros((len(q), len(index.centres)), bool)
                np.put_along_axis(chosen, near, True, axis=1)
                zeros = np.zeros(len(q), bool)
                if least is not None:
                    limit = pdf[least].to_numpy(np.float64)[:, None] - ROUNDING
                    chosen = ~chosen & (index.bounds(q) >= limit)
                    zeros = limit[:, 0] <= 0.0
                chosen &= index.sizes[:-1] > 0
                qi, cell = np.nonzero(np.c_[chosen, zeros & (index.sizes[NO_CELL] > 0)])
                cell = np.where(cell == len(index.centres), NO_CELL, cell).astype(np.int32)
                step = max(1, WANTED_BYTES // (8 * q.shape[1]))
                for a in range(0, len(qi), step):
                    yield pdf[out].iloc[qi[a : a + step]].assign(cell=cell[a : a + step])

    return asked.mapInPandas(run, schema)


def search(cells: Cells, pairs: DataFrame, k: int, vec: str = "vec", filters: Sequence[str] = (), shard_rows: int = SHARD_ROWS,
           query_rows: int = QUERY_ROWS) -> tuple[DataFrame, int]:
    """(query_id, <id>, similarity): the k best rows of each part of each wanted cell for every query that wants it; and the number
    of rows of the index that move. ``vec`` or ``code`` is compared. Cells of many rows are cut into parts, those of many queries into blocks."""
    counts = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
    plan = [(int(c), int(-(-n // query_rows)), int(-(-cells.sizes[c] // shard_rows))) for c, n in counts.items()]
    moved = sum(int(cells.sizes[c]) * blocks for c, blocks, _ in plan)
    id_type, query_type = cells.rows.schema[cells.id_col].dataType, pairs.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField(cells.id_col, id_type), T.StructField("similarity", T.DoubleType())])
    spark = pairs.sparkSession
    table = spark.createDataFrame(plan, "cell int, blocks int, shards int")  # at most MAX_CELLS + 1 rows
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    dealt = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.col(n)).cast("int")
    left = cells.rows.join(F.broadcast(table), "cell").select(
        "cell", F.col(cells.id_col).alias("id"), F.col(vec).alias("x"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(filters)],
        dealt(cells.id_col, "shards").alias("shard"), each("blocks").alias("block"))
    right = pairs.join(F.broadcast(table), "cell").withColumn("block", dealt("query_id", "blocks")).withColumn("shard", each("shards")).drop("blocks", "shards")
    places, kind, id_col = range(len(filters)), "<f8" if vec == "vec" else "int8", cells.id_col

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        q, i, s = best_rows(asked["query_id"].to_numpy(), unit(matrix(asked["q"], "<f8")), [asked[f"q{p}"] for p in places],
                            rows["id"].to_numpy(), unit(matrix(rows["x"], kind)), [rows[f"x{p}"] for p in places], k)
        return pd.DataFrame({"query_id": q, id_col: i, "similarity": s})

    key = ["cell", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, schema), moved


def exact_topk(cells: Cells, queries: DataFrame, k: int, query_id: str, query_vec: str, corpus_filter: Sequence[str] = (),
               query_filter: Sequence[str] = (), shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, int]:
    """Candidates (query_id, <id>, similarity) that hold the k best rows of every query, and the number of rows that moved."""
    asked = materialize(_asked(queries, query_id, query_vec, query_filter))
    size = dict(filters=corpus_filter, shard_rows=shard_rows, query_rows=query_rows)
    near, moved = search(cells, materialize(wanted_cells(cells, asked, FIRST_PROBES)), k, **size)
    near = materialize(near)
    sim = F.col("similarity")
    # the k-th similarity so far; without k rows every cell may matter
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list(sim), asc=False).alias("s")).select(
        "query_id", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(-2.0)).alias("least"))
    limits = asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    far, more = search(cells, materialize(wanted_cells(cells, limits, FIRST_PROBES, "least")), k, **size)
    return near.unionAll(far), moved + more


def probes_for(cells: Cells, sample: DataFrame, hits: DataFrame, recall: float) -> int:
    """The least number of nearest cells that holds the share ``recall`` of ``hits`` (query_id, <id>), the true neighbours of
    ``sample`` (query_id, q). Both are small: as many as the measuring sample has."""
    asked = sample.toPandas()
    if not len(asked):
        return 1
    order = np.argsort(-(unit(matrix(asked["q"], "<f8")) @ cells.centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    at = dict(zip(asked["query_id"], range(len(asked))))
    found = hits.join(cells.rows.select(cells.id_col, "cell"), cells.id_col).where(F.col("cell") != NO_CELL).select("query_id", "cell").toPandas()
    if not len(found):
        return 1
    needed = np.sort(place[[at[q] for q in found["query_id"]], found["cell"]])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1
