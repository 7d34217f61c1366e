"""Nearest neighbours by vantage-point trees, one per shard of the table.

Rows are dealt to shards by a hash of their id, queries to blocks; every (shard, block) pair is one group
of bounded size that builds the shard's tree, lets the block descend it together and keeps k rows per query.
Tables grow by more shards and blocks, never by larger ones. Spark's row_number filter cuts the shards'
answers to k before they are shuffled once more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF_ROWS = 64
#: Relaxation of the pruning bound, see ``Search``; 1 is exact.
FACTOR = 1.0
#: Room for rounding when a bound is compared with a distance.
SLACK = 1e-9


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: int = -1
    border: float = 0.0  # rows nearer to the vantage point are inside
    inside: "Node | None" = None
    outside: "Node | None" = None
    near: tuple[float, float] = (0.0, 0.0)  # least and largest distance from the vantage point inside
    far: tuple[float, float] = field(default=(0.0, 0.0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``, from differences of components (not from
    products, so that equal vectors are at distance 0)."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def build(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Node:
    """Tree over ``rows`` of ``x``. The vantage point is the candidate of the widest spread of distances; rows
    at equal distance stay together, and rows that no border parts become one leaf."""
    if len(rows) <= LEAF_ROWS:
        return Node(rows=rows)
    some = x[rng.choice(rows, min(64, len(rows)), replace=False)]
    tried = rng.choice(rows, min(5, len(rows)), replace=False)
    vantage = int(tried[distances(x[tried], some).var(axis=1).argmax()])
    d = distances(x[[vantage]], x[rows])[0]
    border = float(np.median(d))
    inside = d < border
    if not inside.any():  # the median is the least distance: part the rows beyond it, if there are any
        inside = d <= border
    if inside.all():
        return Node(rows=rows)
    left, right = d[inside], d[~inside]
    return Node(None, vantage, border, build(x, rows[inside], rng), build(x, rows[~inside], rng),
                (float(left.min()), float(left.max())), (float(right.min()), float(right.max())))


class Search:
    """k nearest rows of each query, ties to the smaller id.

    A subtree whose rows lie between ``low`` and ``high`` of the vantage point is at least
    max(d - high, low - d) away from a query at distance d. It is skipped if that bound exceeds ``factor``
    times the distance of the k-th row found so far: factor 1 is exact, smaller ones skip more.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
        self.x, self.ids, self.q, self.qid, self.k, self.factor = x, ids, queries, query_ids, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.seen = 0  # distances taken

    def offer(self, which: np.ndarray, rows: np.ndarray) -> None:
        d = distances(self.q[which], self.x[rows])
        self.seen += d.size
        names = np.broadcast_to(self.ids[rows], d.shape)
        d = np.where(names == self.qid[which][:, None], np.inf, d)  # not the query's own row
        d, names = np.hstack([self.best[which], d]), np.hstack([self.best_id[which], names])
        names = np.where(np.isinf(d), np.iinfo(np.int64).max, names)
        order = np.lexsort((names, d), axis=1)
        by_d, by_name = np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)
        again = (by_d[:, 1:] == by_d[:, :-1]) & (by_name[:, 1:] == by_name[:, :-1]) & np.isfinite(by_d[:, 1:])
        if again.any():  # an id at a distance takes one place
            by_d[:, 1:][again], by_name[:, 1:][again] = np.inf, np.iinfo(np.int64).max
            d, names, order = by_d, by_name, np.lexsort((by_name, by_d), axis=1)
        order = order[:, : self.k]
        self.best[which], self.best_id[which] = np.take_along_axis(d, order, 1), np.take_along_axis(names, order, 1)

    def descend(self, node: Node, which: np.ndarray) -> None:
        if not len(which):
            return
        if node.rows is not None:
            return self.offer(which, node.rows)
        d = distances(self.q[which], self.x[[node.vantage]])[:, 0]
        self.seen += len(d)
        for first in (True, False):
            mine = (d < node.border) == first
            for child, (low, high) in (((node.inside, node.near), (node.outside, node.far)) if first
                                       else ((node.outside, node.far), (node.inside, node.near))):
                bound = np.maximum(d - high, low - d)
                go = mine & (bound <= self.factor * self.best[which, -1] + SLACK)
                self.descend(child, which[go])


def search_shard(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> Search:
    """Of rows with equal vectors only the k + 1 smallest ids can be among a query's k nearest, so a vector that
    fills the shard is searched once. No row repeats an id and vector."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    _, group = np.unique(x, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]]) if len(by) else np.zeros(0, int)
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    keep = np.sort(by[place <= k])
    x, ids = x[keep], ids[keep]
    found = Search(x, ids, queries, query_ids, k, factor)
    found.descend(build(x, np.arange(len(x)), np.random.default_rng(len(x))), np.arange(len(queries)))
    return found


def usable(embedding: str) -> str:
    """SQL condition: not null, no null or non-finite component, not zero."""
    return (f"{embedding} is not null and forall({embedding}, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) "
            f"and exists({embedding}, v -> v <> 0)")


def nearest(vectors: DataFrame, k: int = 10, query_modulus: int = 100, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each row whose id is divisible by
    ``query_modulus``; score is the Euclidean distance in double precision.

    All rows but the query's own (by id) are candidates; with fewer than k, all of them come back. Vectors
    that are null, zero, or hold null or non-finite components, and rows with a null id, take no part.
    Vectors of another length than the first one's are compared with none but their like: each length is a
    table of its own. Rows that repeat an id and vector are one row; ties go to the smaller id. An empty
    table gives no rows. ``factor`` below 1 skips more of the trees and may miss neighbours.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").where(usable("embedding"))
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    v = written(v.dropDuplicates(["vec_id", "embedding"]), "vectors")
    queries = v.where(F.col("vec_id") % query_modulus == 0)
    sizes = v.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % query_modulus == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["q"] // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    rows = v.select("vec_id", "embedding", "dim", dealt(shards, "shard").alias("shard"), every(blocks).alias("block"))
    asked = queries.select("vec_id", "embedding", "dim", dealt(blocks, "block").alias("block"), every(shards).alias("shard"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        theirs = theirs.drop_duplicates("vec_id")
        found = search_shard(np.stack(mine["embedding"]), mine["vec_id"].to_numpy(), np.stack(theirs["embedding"]),
                             theirs["vec_id"].to_numpy(), k, factor)
        out = pd.DataFrame({"query_id": np.repeat(found.qid, k), "vec_id": found.best_id.ravel(), "score": found.best.ravel()})
        return out[np.isfinite(out["score"])]

    key = ["shard", "block", "dim"]
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
