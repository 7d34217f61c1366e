"""Isolation forest (Liu, Ting & Zhou, 2008) as Spark jobs.

* Sampling: a row's md5 with the run gives its place in a random order; consecutive slices of ``psi`` rows of that order are
  the samples of the trees, and where the table is too small for all trees a further order follows. Only rows with small
  hashes, about ``1.5 * trees * psi`` of them, take part: bounded by the parameters, not by the data.
* Fit: one group per (run, tree) of at most psi rows, grown level by level. Feature and split are drawn from the md5 of
  (seed, run, tree, node), so nothing depends on partitions or the order of rows, and plain SQL can draw the same trees.
  Nodes are numbered as in a heap: the root is 1, the children of n are 2n and 2n + 1.
* Score: trees are dealt into blocks of bounded size; a block is broadcast, every row walks through it, and path
  lengths, whole numbers of 1e-9, add up by row over the blocks in any order to the same sum.
* Decision: ``score - percentile(score, contamination)``, anomaly when < 0; the percentile is
  the exact bounded-memory one.

Semantics follow the common library definition: height limit ceil(log2 psi), random
feature among non-constant ones, uniform split value, path length + c(leaf size),
score = 2^(-E[h] / c(psi)), reported negated so that lower = more anomalous.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.config import FOREST_EXPERIMENTS, FOREST_SEED
from quillspark.functions.exprs import np_round, with_scalars
from quillspark.functions.quantiles import exact_percentiles
from quillspark.session import materialize

EULER_GAMMA = 0.5772156649015329
POOL = 1.5                 # rows that take part in the sampling, as a multiple of those that the trees hold
PATH_UNIT = 1_000_000_000  # path lengths are whole numbers of 1 / PATH_UNIT
BLOCK_SLOTS = 2_000_000    # heap places of a block of trees (20 bytes each); a larger tree is a block of its own
BLOCK_ROWS = 8192          # rows that walk together
TASK_STEPS = 8_000_000     # rows x trees that a scoring task aims at
MAX_TASKS = 10_000


NODE_SCHEMA = "run_id int, tree_id int, node_id long, feature int, threshold double, size long, psi long"


@dataclass(frozen=True)
class ForestParams:
    run_id: int
    n_estimators: int
    contamination: float
    max_samples: int = 0        # 0 = auto = min(256, n)
    seed: int = FOREST_SEED


def experiments() -> list[ForestParams]:
    return [ForestParams(i + 1, t, c, m) for i, (t, c, m) in enumerate(FOREST_EXPERIMENTS)]


def avg_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search; c(1) = 0, c(2) = 1."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _digits(text: Column, place: int) -> Column:
    """A number in [0, 1) from 13 hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(text), place, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _psi(p: ForestParams) -> Column:
    """Rows per tree: max_samples, or min(256, n) when auto; never more than n."""
    return F.least(F.lit(p.max_samples or 256), F.col("__n"))


def sample_trees(matrix: DataFrame, id_col: str, runs: Sequence[ForestParams]) -> DataFrame:
    """Rows (run_id, tree_id, __psi, <id>, features...) holding each tree's psi-row sample.

    Order r of a run is that of md5("seed:run:r:id"); rows that share an id go by their values. The first
    ``slices = min(trees, n / psi)`` slices of psi rows are the trees r * slices, r * slices + 1, ... One group per (run, order)
    is ranked: at most about POOL * trees * psi rows.
    """
    m = with_scalars(matrix, matrix.agg(F.count(F.lit(1)).alias("__n"))).where("__n > 0")
    others = [c for c in matrix.columns if c != id_col]
    key = lambda p, r: F.concat_ws(":", F.lit(p.seed), F.lit(p.run_id), r, F.col(id_col))
    parts = []
    for p in runs:
        slices = F.least(F.lit(p.n_estimators), F.floor(F.col("__n") / _psi(p))).cast("int")
        m_p = m.withColumn("__psi", _psi(p).cast("bigint")).withColumn("__slices", slices)
        share = F.lit(POOL) * F.col("__slices") * F.col("__psi") / F.col("__n")
        orders = F.filter(F.expr(f"sequence(0, ({p.n_estimators} - 1) div __slices)"), lambda r: _digits(key(p, r), 1) < share)
        parts.append(m_p.select(F.lit(p.run_id).alias("run_id"), F.lit(p.n_estimators).alias("__trees"), F.explode(orders).alias("__order"),
                                "__psi", "__slices", *matrix.columns).withColumn("__h", F.md5(key(p, F.col("__order")))))
    pool = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("run_id", "__order").orderBy("__h", F.col(id_col), *others)
    ranked = pool.withColumn("__r", F.row_number().over(w) - 1)
    ranked = ranked.where("__r < __slices * __psi").withColumn("tree_id", F.expr("cast(__order * __slices + __r div __psi as int)"))
    return ranked.where("tree_id < __trees").select("run_id", "tree_id", "__psi", *matrix.columns)


def draws(seed: int, run: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1) that a node draws: the first for its feature, the second for its threshold."""
    digits = hashlib.md5(f"{seed}:{run}:{tree}:{node}".encode()).hexdigest()
    return int(digits[:13], 16) / (1 << 52), int(digits[13:26], 16) / (1 << 52)


def grow(x: np.ndarray, psi: int, seed: int, run: int, tree: int) -> list[tuple[int, int | None, float | None, int]]:
    """(node, feature, threshold, size) of all nodes of the tree on ``x``. The order of the rows plays no part."""
    nodes, level, height = [], [(1, x)], 0
    while level:
        below = []
        for node, rows in level:
            varied = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and (1 << height) < psi else ()
            if not len(varied):
                nodes.append((node, None, None, len(rows)))
                continue
            u, v = draws(seed, run, tree, node)
            f = int(varied[int(u * len(varied))])
            column = rows[:, f]
            lo, hi = float(column.min()), float(column.max())
            t = lo + v * (hi - lo)
            nodes.append((node, f, t, len(rows)))
            right = column > t
            below += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        level, height = below, height + 1
    return nodes


def fit(matrix: DataFrame, feature_cols: Sequence[str], runs: Sequence[ForestParams], id_col: str = "invoice_id") -> DataFrame:
    """The ``trees`` table, one row per node of every tree of every run: run_id, tree_id, node_id, feature and threshold (null
    at a leaf), size, psi. One shuffle of the samples; a group is one tree, at most psi rows. No rows give no trees."""
    cols = list(feature_cols)
    seeds = {p.run_id: p.seed for p in runs}

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, tree = map(int, key)
        psi = int(pdf["__psi"].iloc[0])
        node, feature, threshold, size = zip(*grow(pdf[cols].to_numpy(np.float64), psi, seeds[run], run, tree))
        return pd.DataFrame({"run_id": np.int32(run), "tree_id": np.int32(tree), "node_id": np.array(node, np.int64),
                             "feature": pd.array(feature, "Int32"), "threshold": pd.array(threshold, "Float64"),
                             "size": np.array(size, np.int64), "psi": np.int64(psi)})

    samples = sample_trees(matrix.select(id_col, *cols), id_col, runs)
    return samples.groupBy("run_id", "tree_id").applyInPandas(build, NODE_SCHEMA)


def tree_blocks(trees: DataFrame, block_slots: int = BLOCK_SLOTS) -> tuple[list[list[tuple[int, int, int]]], dict[int, tuple[int, int]]]:
    """Trees dealt into blocks of at most ``block_slots`` heap places: per block (run, tree, height) in order; per run its
    number of trees and psi. One row per tree reaches the driver: bounded by the parameters of the runs."""
    height = F.floor(F.log2(F.max("node_id").cast("double"))).cast("int")
    rows = trees.groupBy("run_id", "tree_id").agg(height.alias("height"), F.max("psi").alias("psi")).orderBy("run_id", "tree_id").collect()
    blocks, used, runs = [], block_slots, {}
    for r in rows:
        size = 2 << r["height"]
        if used + size > block_slots:
            blocks.append([])
            used = 0
        blocks[-1].append((r["run_id"], r["tree_id"], r["height"]))
        used += size
        n, _ = runs.get(r["run_id"], (0, 0))
        runs[r["run_id"]] = (n + 1, r["psi"])
    return blocks, runs


def block_arrays(nodes: pd.DataFrame, block: list[tuple[int, int, int]]) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree of a block: run, height, and by heap place the feature, the threshold and, at the last level, the path length
    in units. Above that level a leaf sends its rows to the left (threshold infinity), where its length awaits them."""
    out, groups = [], dict(tuple(nodes.groupby(["run_id", "tree_id"])))
    for run, tree, height in block:
        g = groups[run, tree]
        place = g["node_id"].to_numpy(np.int64)
        depth = np.floor(np.log2(place)).astype(np.int64)
        feature, threshold = np.zeros(2 << height, np.int32), np.full(2 << height, np.inf)
        inner = g["feature"].notna().to_numpy()
        feature[place[inner]] = g["feature"].to_numpy(np.float64)[inner].astype(np.int32)
        threshold[place[inner]] = g["threshold"].to_numpy(np.float64)[inner]
        length = np.zeros(2 << height, np.int64)
        leaf = ~inner
        units = depth[leaf] * PATH_UNIT + np.rint(avg_path_length(g["size"].to_numpy()[leaf]) * PATH_UNIT).astype(np.int64)
        length[place[leaf] << (height - depth[leaf])] = units
        out.append((run, height, feature, threshold, length))
    return out


def path_sums(x: np.ndarray, block: list) -> dict[int, np.ndarray]:
    """Per run the sums of the path lengths of rows ``x`` over the trees of a block."""
    sums: dict[int, np.ndarray] = {}
    flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x), dtype=np.int64) * x.shape[1]
    for run, height, feature, threshold, length in block:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(height):
            right = flat.take(base + feature.take(node)) > threshold.take(node)
            node <<= 1
            node += right
        sums[run] = sums.get(run, 0) + length.take(node)
    return sums


def score(matrix: DataFrame, feature_cols: Sequence[str], trees: DataFrame, id_cols: Sequence[str] = ("invoice_id",),
          block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Long table (run_id, ids..., score) with the raw score of every row under every run's forest.

    One block: every row walks through it where it lies. More blocks: rows get a number, each block's path lengths are
    a pass over the rows, and one aggregation adds them up. No forest, no rows of scores. A forest of any size is scored; a
    task holds one block and a batch of rows.
    """
    spark, cols, ids = matrix.sparkSession, list(feature_cols), list(id_cols)
    blocks, runs = tree_blocks(trees, block_slots)
    rows = matrix.select(*ids, *cols)
    keys = list(ids)
    if len(blocks) > 1:
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
        keys.append("__row")
    schema = T.StructType([T.StructField("run_id", T.IntegerType()), *[rows.schema[c] for c in keys], T.StructField("__sum", T.LongType())])
    # a row walks through every tree: tasks are sized by steps, not by the few bytes that a row has
    tasks = min(MAX_TASKS, -(-rows.count() * max(1, max(map(len, blocks), default=0)) // TASK_STEPS))
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)

    def walk(shipped):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), BLOCK_ROWS):
                    part = pdf.iloc[a : a + BLOCK_ROWS]
                    for run_id, total in path_sums(part[cols].to_numpy(np.float64), shipped.value).items():
                        out = part[keys].copy()
                        out.insert(0, "run_id", np.int32(run_id))
                        out["__sum"] = total
                        yield out
        return run

    parts = []
    for block in blocks:
        wanted = spark.createDataFrame([b[:2] for b in block], "run_id int, tree_id int")  # a row per tree of the block
        nodes = trees.join(F.broadcast(wanted), ["run_id", "tree_id"], "left_semi").select("run_id", "tree_id", "node_id", "feature", "threshold", "size").toPandas()
        parts.append(rows.mapInPandas(walk(spark.sparkContext.broadcast(block_arrays(nodes, block))), schema))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    sums = reduce(DataFrame.unionAll, parts)
    if len(blocks) > 1:
        sums = sums.groupBy("run_id", *keys).agg(F.sum("__sum").alias("__sum"))
    scale = F.create_map(*[F.lit(x) for run, (n, psi) in runs.items()
                           for x in (run, float(PATH_UNIT) * n * float(avg_path_length(np.array([max(psi, 2)]))[0]))])
    return sums.select("run_id", *ids, (-F.pow(F.lit(2.0), -F.col("__sum") / scale[F.col("run_id")])).alias("score"))


def decide(scores: DataFrame, runs: Sequence[ForestParams]) -> tuple[DataFrame, DataFrame]:
    """Per run: offset = exact percentile of its scores at its ``contamination``; decision = score - offset.

    One grouped percentile plan (by run_id) serves every run. Returns (decisions, offsets); the
    offsets table has one row per run (a parameter-sized table, broadcast back).
    """
    levels = sorted({p.contamination for p in runs})
    cuts = exact_percentiles(scores, "score", levels, names=[f"__c{i}" for i in range(len(levels))], by=["run_id"], few_groups=True)
    pick = F.lit(None).cast("double")
    for p in runs:
        pick = F.when(F.col("run_id") == p.run_id, F.col(f"__c{levels.index(p.contamination)}")).otherwise(pick)
    offsets = cuts.select("run_id", pick.alias("offset"))
    decisions = (scores.join(F.broadcast(offsets), "run_id")
                 .withColumn("anomaly_score", F.col("score") - F.col("offset"))
                 .withColumn("is_anomaly", F.col("anomaly_score") < 0).drop("score", "offset"))
    return decisions, offsets


def run_metrics(decisions: DataFrame, runs: Sequence[ForestParams], n_features: int) -> DataFrame:
    """The ``runs`` table: parameters and metrics (n_anomalies, anomaly_rate, mean_score, min_score)."""
    params = decisions.sparkSession.createDataFrame(
        [(p.run_id, p.n_estimators, float(p.contamination), p.max_samples or None, p.seed) for p in runs],
        "run_id int, n_estimators int, contamination double, max_samples int, seed int")
    n = F.count(F.lit(1))
    metrics = decisions.groupBy("run_id").agg(
        n.cast("bigint").alias("n_records"),
        F.count_if("is_anomaly").cast("bigint").alias("n_anomalies"),
        np_round(F.count_if("is_anomaly") / n, 4).alias("anomaly_rate"),
        np_round(F.avg("anomaly_score"), 4).alias("mean_score"),
        np_round(F.min("anomaly_score"), 4).alias("min_score"))
    return (params.join(metrics, "run_id").withColumn("n_features", F.lit(n_features))
            .withColumn("version", F.col("run_id")))


def latest(runs: DataFrame) -> DataFrame:
    """Model resolution: the run with the highest version."""
    return runs.orderBy(F.col("version").desc()).limit(1)
