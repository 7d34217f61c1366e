import math

import numpy as np
import pytest

from quillspark.llm import itq, vptree

VECS = "vec_id long, embedding array<float>, label int, shard int, block int, dim int, cls int, e int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) + (1,) * 7 for i, v in rows], VECS).repartition(3)


def clustered(n, dims=16, seed=0, spread=0.12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(1, n // 6), dims))
    x = (base[rng.integers(0, len(base), n)] + spread * rng.standard_normal((n, dims))).astype(np.float32)
    return x


BAD = [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [math.nan] + [1.0] * 15), (904, [math.inf] + [1.0] * 15), (905, [])]


def brute_nearest(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = []
    for q in sorted(set(ids[ids % 100 == 0])):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        near = sorted({(float(a), int(b)) for a, b in zip(d, ids) if b != q})[:k]
        out += [(int(q), r + 1, i, s) for r, (s, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 150])
def test_nearest_is_exact_at_factor_one(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF_ROWS", 8)
    x = clustered(600)
    x[50:120] = x[50]  # many equal vectors: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    more = rows + [(100, rows[100][1])] + BAD
    got = sorted(tuple(r) for r in vptree.nearest(frame(spark, more), shard_rows=shard_rows, query_rows=4).collect())
    want = sorted(brute_nearest(rows, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_pruning_saves_distances_and_a_smaller_factor_more():
    x = clustered(3000, 8, spread=0.02).astype(np.float64)
    ids, q = np.arange(len(x)), np.arange(0, 3000, 100)
    seen, recall = [], []
    truth = None
    for factor in (1.0, 0.5):
        s = vptree.search_shard(x, ids, x[q], ids[q], 10, factor)
        truth = s.best_id if truth is None else truth
        seen.append(s.seen)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(s.best_id, truth)]))
    assert seen[0] < 0.7 * len(x) * len(q) and seen[1] < seen[0]
    assert recall[0] == 1 and recall[1] >= 0.9


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0]), (200, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in vptree.nearest(frame(spark, rows)).collect()}
    assert got == {(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)}
    assert vptree.nearest(frame(spark, [])).collect() == []
    assert vptree.nearest(frame(spark, BAD)).collect() == []


def brute_links(rows, threshold):
    x = np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in rows])
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_links_against_all_pairs(spark, block_rows, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(itq, "RECALL", 0.9999)
    x = clustered(500, seed=3)
    x[:60] = x[0]  # equal vectors
    x[60:160] = x[60] + 0.01 * np.random.default_rng(1).standard_normal((100, 16)).astype(np.float32)  # a large group of near ones
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in itq.near_duplicates(frame(spark, rows + BAD), recall=0.9999).collect()}
    links, label = brute_links(rows, 0.9)
    mine = np.array([got[i]["n_links"] for i, _ in rows])
    assert (mine <= links).all() and mine.sum() >= 0.995 * links.sum()
    assert np.mean([got[i]["component_id"] == c for (i, _), c in zip(rows, label)]) >= 0.98
    for i, _ in BAD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_repeats_lengths_and_nothing(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (9, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 3, 5, False), (3, 0, 3, True), (5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False)]
    assert itq.near_duplicates(frame(spark, [])).collect() == []
    assert [r["n_links"] for r in itq.near_duplicates(frame(spark, BAD)).collect()] == [0] * len(BAD)


def test_repeated_rows_take_one_place(spark):
    """A near row that comes more often than k times, and an id with two vectors equally far, are one neighbour each."""
    rows = [(0, [0.0, 0.0, 1.0])] + [(i, [float(i), 0.0, 1.0]) for i in range(1, 31)]
    more = rows + [rows[1]] * 25 + [rows[0]] * 15 + [(1, [-1.0, 0.0, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vptree.nearest(frame(spark, more)).collect())
    assert got == [(0, r, r) for r in range(1, 11)]
