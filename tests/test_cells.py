"""Cells: exact search by metric pruning, the inverted file and its measured probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import cells, vectors


def clustered(spark, n=3000, dims=16, groups=40, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    which = rng.integers(0, groups, n)
    x = centres[which] + 0.15 * rng.normal(size=(n, dims))
    x[:20] = x[20]  # copies
    x[25:30] = 0.0  # zero vectors
    rows = [(i, [float(v) for v in r], int(g) % 3, "x") for i, (r, g) in enumerate(zip(x, which))]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int, cell string").repartition(6)


def brute(x, ids, kinds, queries, k):
    u = cells.unit(x)
    out = {}
    for q, kind in queries:
        s = np.round(1.0 - (1.0 - u @ u[q]), 4)
        at = [i for i in ids if kind is None or kinds[i] == kind]
        out[q] = [(i, s[i]) for i in sorted(at, key=lambda i: (-s[i], i))[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    return out


@pytest.fixture(scope="module")
def data(spark):
    x, df = clustered(spark)
    return x, df.cache()


@pytest.mark.parametrize("shard_rows, query_rows", [(16_384, 16_384), (30, 5)])
def test_cells_and_scan_give_the_exact_rows(spark, data, shard_rows, query_rows):
    x, df = data
    kinds = {r.vec_id: r.kind for r in df.select("vec_id", "kind").collect()}
    asked = [(q, [None, 0, 1, 2, 7][q % 5]) for q in range(0, 3000, 27)] + [(25, None), (26, 1), (3, None)]
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")).join(
        spark.createDataFrame([q for q in asked], "query_id long, want int"), "query_id")
    want = brute(x, range(3000), kinds, asked, 4)
    args = dict(corpus_id="vec_id", corpus_filter="kind", query_filter="want")
    got = answers(vectors.knn_topk(df, queries, 4, few=0, shard_rows=shard_rows, query_rows=query_rows, **args))
    assert got == {q: w for q, w in want.items() if w}
    assert answers(vectors.knn_topk(df, queries, 4, **args)) == got


def test_few_rows_move_where_vectors_lie_in_cells(spark, data):
    """Each row moves at most once for the queries of its cell, and most cells are not wanted by a query."""
    _, df = data
    index = cells.build_cells(df.where("vec_id >= 30"), "vec_id", "embedding")
    one = df.where("vec_id = 77").selectExpr("vec_id query_id", "embedding query_vec")
    _, moved = cells.exact_topk(index, one, 5, "query_id", "query_vec")
    assert moved < 0.25 * index.sizes.sum()
    many = df.where("vec_id % 2 = 0 and vec_id >= 30").selectExpr("vec_id query_id", "embedding query_vec")
    _, moved = cells.exact_topk(index, many, 5, "query_id", "query_vec")
    assert moved <= 2 * index.sizes.sum()  # two rounds, one block of queries per cell


def test_bounds_hold_for_every_row(spark, data):
    x, df = data
    index = cells.build_cells(df, "vec_id", "embedding")
    u, bounds = cells.unit(x), index.bounds(cells.unit(x[:200]))
    for r in index.rows.select("vec_id", "cell").where("cell >= 0").collect():
        assert (u[:200] @ u[r.vec_id] <= bounds[:, r.cell] + 1e-12).all()
    assert index.sizes.sum() == 3000 and index.sizes[cells.NO_CELL] == 5


def test_inverted_file_reads_little_and_finds_most(spark, data):
    x, df = data
    df = df.where("vec_id >= 30")
    index = cells.build_cells(df, "vec_id", "embedding")
    probes = vectors.measured_probes(index, 5, recall=0.98)
    queries = df.where("vec_id % 15 = 0").selectExpr("vec_id query_id", "embedding query_vec")
    asked = cells._asked(queries, "query_id", "query_vec", ())
    wanted = cells.wanted_cells(index, asked, probes).groupBy("query_id").agg(F.collect_list("cell").alias("c")).collect()
    assert np.mean([index.sizes[r.c].sum() for r in wanted]) < 0.10 * index.sizes.sum()
    approx = answers(vectors.ann_topk(df, queries, 5, corpus_id="vec_id", index=index, probes=probes))
    exact = brute(x, range(30, 3000), {}, [(q, None) for q in approx], 5)
    hits = sum(len({i for i, _ in approx[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert len(exact) == queries.count() and hits >= 0.95 * 5 * len(exact)


def test_probes_follow_the_wanted_recall(spark):
    """In noise, neighbours lie in many cells: the measured number says so, and the recall holds."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = cells.build_cells(df, "vec_id", "embedding")
    few, many = (vectors.measured_probes(index, 5, recall=r) for r in (0.5, 0.98))
    assert few < many <= len(index.centres)
    queries = df.where("vec_id % 15 = 7").selectExpr("vec_id query_id", "embedding query_vec")
    approx = answers(vectors.ann_topk(df, queries, 5, corpus_id="vec_id", index=index, probes=many))
    exact = brute(x, range(1500), {}, [(q, None) for q in approx], 5)
    assert sum(len({i for i, _ in approx[q]} & {i for i, _ in exact[q]}) for q in exact) >= 0.95 * 5 * len(exact)


def test_tiny_and_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query_vec array<double>")
    for few in (0, 10):
        assert vectors.knn_topk(empty, queries, 3, corpus_id="vec_id", few=few).collect() == []
        if not few:
            assert vectors.ann_topk(empty, queries, 3, corpus_id="vec_id").collect() == []
        one = spark.createDataFrame([(5, [2.0, 0.0]), (6, [0.0, 0.0])], "vec_id long, embedding array<double>")
        assert answers(vectors.knn_topk(one, queries, 3, corpus_id="vec_id", few=few)) == {1: [(5, 1.0), (6, 0.0)], 2: [(5, 0.0), (6, 0.0)]}
        assert vectors.knn_topk(one, queries.where("query_id > 9"), 3, corpus_id="vec_id", few=few).collect() == []
