"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Principal axes and rotations that make balanced binary codes are learned on a bounded sample
   (iterative quantisation: alternate sign codes and the orthogonal Procrustes rotation).
2. Every vector gets codes from a few rotations; each code is cut into disjoint substrings, and every substring
   is one hash table. The length of a substring grows with the logarithm of the table, the number of tables
   follows from the wanted recall at the threshold.
3. Vectors that share a bucket are compared by cosine of the original components in double precision, block
   by block. A pair counts in the first table where it meets only, so counts are exact for pairs found.

Buckets return counts per vector and a spanning forest, never pairs. Equal vectors are one row with a weight.
Buckets with very many rows are cut into blocks that meet two by two in tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, written
from quillspark.llm.vptree import usable

THRESHOLD = 0.9
#: Vectors that the rotations are learned on, at most.
SAMPLE_ROWS = 10_000
ROUNDS = 30
#: Wanted chance that a pair right at the threshold meets in some table, and rows a bucket should have.
RECALL = 0.998
BUCKET_ROWS = 128
#: Rows of a block of a large bucket.
BLOCK_ROWS = 2048
SEED = 7


def plan_tables(n: int, dims: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int, int]:
    """(bits of a substring, substrings of a code, rotations, tables). A hyperplane parts a pair at angle a with chance
    a / pi, so a substring of s bits agrees with chance (1 - a / pi) ** s."""
    bits = min(max(4, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))) if n > BUCKET_ROWS else 4, dims, 62)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    tables = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree))
    per_code = max(1, dims // bits)
    return bits, per_code, max(1, -(-tables // per_code)), max(1, tables)


def learn_rotations(sample: np.ndarray, rotations: int, rounds: int = ROUNDS) -> np.ndarray:
    """Projections (rotations, dims, dims) whose signs are the code bits of a unit vector.

    Unit vectors are not centred, so that the sign of every projection is a hyperplane through the origin
    and the angle between two vectors bounds the bits they differ in.
    """
    dims = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        v = sample @ axes
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        out.append(axes @ r)
    return np.stack(out)


def bucket_links(ids: np.ndarray, x: np.ndarray, subs: np.ndarray, table: int, weight: np.ndarray, cut: int,
                 threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links inside one bucket between rows [:cut] and [cut:] (all with all if ``cut`` is 0): for each row
    the weight of rows linked in this table first, and the edges of a spanning forest of all links."""
    n = len(ids)
    count, label = np.zeros(n, dtype=np.int64), np.arange(n)
    left, right = (np.arange(n), np.arange(n)) if cut == 0 else (np.arange(cut), np.arange(cut, n))
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        linked = x[rows] @ x[right].T >= threshold
        linked &= rows[:, None] != right[None, :]
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        a, b = rows[i], right[j]
        new = np.ones(len(a), dtype=bool)
        for t in range(table):
            new &= subs[a, t] != subs[b, t]
        count += np.bincount(a[new], weight[b[new]], n).astype(np.int64)
        if cut:
            count += np.bincount(b[new], weight[a[new]], n).astype(np.int64)
        for r in np.unique(i):
            near = label[np.r_[rows[r], right[linked[r]]]]
            if near.min() != near.max():
                label[np.isin(label, near)] = near.min()
    return count, [(int(ids[k]), int(ids[label[k]])) for k in np.flatnonzero(label != np.arange(n))]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``): vec_id, n_links, component_id, kept.

    n_links is the number of other rows linked directly (cosine of at least ``threshold``), component_id the
    smallest vec_id that links reach, kept whether that is the row's own. Vectors that are null, zero, or hold
    null or non-finite components link with nothing: 0, own id, kept. Vectors of different length do not link.
    Repeated rows link with each other. Rows with a null id count as links of others, have no component_id of
    their own making, and are not kept. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    good = F.expr(usable("embedding"))
    rows = written(rows.select("vec_id", F.when(good, F.col("embedding").cast("array<double>")).alias("e")), "vectors")
    # equal vectors: one class, named by a hash-independent running number of its own
    classes = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("e")), "classes")
    parts = []
    for r in classes.groupBy("dim").count().orderBy("dim").collect():  # one row per length of vector
        parts.append(_linked(classes.where(F.col("dim") == r["dim"]), r["count"], r["dim"], threshold, recall))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = written(found, "links")
    counts = found.where("other is null").groupBy(F.col("one").alias("cls")).agg(F.sum("n").alias("n"))
    stars = connected_components(found.where("other is not null"), "one", "other")
    at = classes.select("cls", "e", "weight", "least").join(stars.withColumnRenamed("node", "cls"), "cls", "left") \
        .withColumn("root", F.coalesce("root", "cls"))
    at = written(at.join(counts, "cls", "left"), "roots")
    least = at.groupBy("root").agg(F.min("least").alias("component"))
    at = at.join(least, "root").select("e", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.join(at, "e", "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(classes: DataFrame, n: int, dim: int, threshold: float, recall: float) -> DataFrame:
    """(one, other, n): with other null, links of a class in one bucket; else an edge of a spanning forest."""
    share = min(1.0, 2 * SAMPLE_ROWS / n)
    sample = classes.where((F.xxhash64("e") / 2.0**64 + 0.5) < share).select("e").limit(SAMPLE_ROWS).toPandas()
    sample = np.stack(sample["e"]) if len(sample) else np.eye(dim)
    bits, per_code, rotations, tables = plan_tables(n, dim, threshold, recall)
    learned = learn_rotations(sample / np.linalg.norm(sample, axis=1, keepdims=True), rotations)
    shipped = classes.sparkSession.sparkContext.broadcast(learned)  # rotations * dim * dim doubles

    def encode(parts):
        power = 1 << np.arange(bits, dtype=np.int64)
        for part in parts:
            x = np.stack(part["e"])
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            subs = [(u @ r[:, k * bits : (k + 1) * bits] >= 0) @ power for r in shipped.value for k in range(per_code)][:tables]
            yield pd.DataFrame({"cls": part["cls"], "weight": part["weight"], "e": part["e"], "subs": list(np.stack(subs, axis=1))})

    coded = classes.select("cls", "weight", "e").mapInPandas(encode, "cls long, weight long, e array<double>, subs array<long>")
    coded = written(coded, "codes")
    at = F.posexplode("subs").alias("t", "sub")
    sizes = coded.select(at).groupBy("t", "sub").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nb"))
    rows = coded.select("cls", "weight", "e", "subs", F.posexplode("subs").alias("t", "sub"))
    large = written(sizes.where("nb > 1"), "large")
    n_large = large.count()
    if n_large:  # a row of a large bucket goes to each pair of blocks that has its own
        rows = rows.join(F.broadcast(large) if n_large <= 1_000_000 else large, ["t", "sub"], "left")
        rows = rows.withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("with"))
        rows = rows.withColumn("pair", F.least("own", "with") * F.col("nb") + F.greatest("own", "with"))
    else:
        rows = rows.select("*", F.lit(0).alias("own"), F.lit(0).cast("int").alias("pair"))

    def links(bucket: pd.DataFrame) -> pd.DataFrame:
        if len(bucket) < 2:
            return pd.DataFrame({"one": [], "other": [], "n": []})
        bucket = bucket.sort_values(["own", "cls"])
        own = bucket["own"].to_numpy()
        x = np.stack(bucket["e"])
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        ids = bucket["cls"].to_numpy()
        cut = int((own == own[0]).sum()) % len(own)
        count, edges = bucket_links(ids, x, np.stack(bucket["subs"]), int(bucket["t"].iloc[0]), bucket["weight"].to_numpy(), cut, threshold)
        some = np.flatnonzero(count)
        one = np.r_[ids[some], [e[0] for e in edges]].astype(np.int64)
        other = pd.array([None] * len(some) + [e[1] for e in edges], dtype="Int64")
        return pd.DataFrame({"one": one, "other": other, "n": np.r_[count[some], np.zeros(len(edges), np.int64)].astype(np.int64)})

    return rows.groupBy("t", "sub", "pair").applyInPandas(links, "one long, other long, n long")
