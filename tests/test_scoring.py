"""Percentiles, tiers, forest, documents, chunks, retrieval, streaming."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.config import RunConfig
from quillspark.functions.quantiles import exact_percentiles, value_ranges
from quillspark.operators import documents, iforest, risk, vectors
from quillspark.plans.catalog import L
from quillspark.session import materialize, scratch_path
from quillspark.streaming import ingest
from tests.conftest import SF_SMALL

CFG = RunConfig()


@pytest.mark.parametrize("accuracy", [20, 1000, 100000])
def test_exact_percentiles_equal_numpy_on_both_paths(spark, accuracy):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.integers(0, 5, 500).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.05, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = list(exact_percentiles(df, "x", probs, accuracy=accuracy).first())
    assert got == [float(v) for v in np.percentile(vals, [p * 100 for p in probs])]


def test_percentiles_of_ten_million_distinct_values_in_ranges(spark):
    """With a coarse sketch nearly all values are in the bands: they are ranked range by range, none of which is large."""
    n = 10_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = exact_percentiles(df, "x", [0.05, 0.5], accuracy=20, range_values=2_000_000).first()
    assert list(got) == [0.05 * (n - 1), 0.5 * (n - 1)]
    members = df.select(F.lit(0).alias("__pid"), F.lit(1).alias("__cls"), F.col("x").alias("__key")).limit(1_000_000)
    sizes = [r["count"] for r in value_ranges(members, [], 100_000).groupBy("__part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 300_000


def test_ranges_give_the_same_percentiles(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g in (1, 2, None) for v in np.r_[rng.normal(size=900), np.zeros(300)]]
    df = spark.createDataFrame(rows, "g int, x double").where("g is not null")
    one = sorted(map(tuple, exact_percentiles(df, "x", [0.0, 0.1, 0.5, 1.0], accuracy=30, by=["g"]).collect()))
    for values in (1, 7, 150):
        assert sorted(map(tuple, exact_percentiles(df, "x", [0.0, 0.1, 0.5, 1.0], accuracy=30, by=["g"], range_values=values).collect())) == one


def test_grouped_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in range(3) for v in rng.normal(g, 1, 700)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.p0 for r in exact_percentiles(df, "x", [0.3], by=["g"], accuracy=50).collect()}
    for g in range(3):
        assert got[g] == float(np.percentile([v for gg, v in rows if gg == g], 30))


def test_tiers_follow_percentiles(spark):
    df = spark.range(1000).select(F.col("id").alias("invoice_id"), (F.col("id") * 1.0).alias("anomaly_score"))
    counts = {r.risk_level: r["count"] for r in risk.risk_tiers(df).groupBy("risk_level").count().collect()}
    assert counts == {"CRITICAL": 50, "HIGH": 50, "MEDIUM": 150, "LOW": 750}


def _toy_matrix(spark, n=2000, outliers=10):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 4))
    x[:outliers] += 8.0
    rows = [(f"ID-{i:05d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "invoice_id string, a double, b double, c double, d double")


def test_forest_ranks_outliers_first_and_meets_contamination(spark):
    m = _toy_matrix(spark)
    cols = ["a", "b", "c", "d"]
    runs = [iforest.ForestParams(1, 60, 0.05, 0)]
    trees = iforest.fit(m, cols, runs)
    dec, _ = iforest.decide(iforest.score(m, cols, trees), runs)
    pdf = dec.toPandas().sort_values(["anomaly_score", "invoice_id"])
    assert set(pdf.invoice_id.head(10)) == {f"ID-{i:05d}" for i in range(10)}
    assert pdf.is_anomaly.sum() == 100                      # floor of the percentile rank + 1 = 5% of 2000
    assert pdf[~pdf.is_anomaly].anomaly_score.mean() > pdf[pdf.is_anomaly].anomaly_score.mean()


def test_forest_is_independent_of_partitioning(spark):
    m = _toy_matrix(spark, n=600, outliers=3)
    cols = ["a", "b", "c", "d"]
    runs = [iforest.ForestParams(1, 20, 0.05, 0), iforest.ForestParams(2, 10, 0.1, 128)]
    a = iforest.score(m.repartition(3), cols, iforest.fit(m.repartition(3), cols, runs)).toPandas()
    b = iforest.score(m.repartition(7), cols, iforest.fit(m.repartition(7), cols, runs)).toPandas()
    key = ["run_id", "invoice_id"]
    a, b = a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True)
    assert (a.score == b.score).all()


def test_tree_sample_sizes(spark):
    m = _toy_matrix(spark, n=5000, outliers=0)
    s = iforest.sample_trees(m, "invoice_id", [iforest.ForestParams(1, 30, 0.05, 0), iforest.ForestParams(2, 4, 0.05, 100)])
    rows = s.select("run_id", "tree_id", "invoice_id").collect()
    sizes = Counter((r.run_id, r.tree_id) for r in rows)
    assert len(sizes) == 34
    assert all(v == 256 for (run, _), v in sizes.items() if run == 1)
    assert all(v == 100 for (run, _), v in sizes.items() if run == 2)
    # trees of one order share no row: the first 19 of run 1 (5000 / 256), and all of run 2
    assert max(Counter(r.invoice_id for r in rows if r.run_id == 1 and r.tree_id < 19).values()) == 1
    assert max(Counter(r.invoice_id for r in rows if r.run_id == 2).values()) == 1


def test_tiny_and_empty_tables_grow_trees(spark):
    cols, runs = ["a", "b", "c", "d"], [iforest.ForestParams(1, 5, 0.05, 0)]
    for n in (0, 1, 2, 3):
        m = _toy_matrix(spark, n=n, outliers=0) if n else spark.createDataFrame([], "invoice_id string, a double, b double, c double, d double")
        trees = iforest.fit(m, cols, runs)
        assert trees.select("tree_id").distinct().count() == (5 if n else 0)
        assert iforest.score(m, cols, trees).count() == n


def test_paths_by_hand(spark):
    """A row's score from the definition: its depth plus c(size) of its leaf, averaged over the trees."""
    m, cols = _toy_matrix(spark, n=300, outliers=2), ["a", "b", "c", "d"]
    trees = iforest.fit(m, cols, [iforest.ForestParams(1, 7, 0.05, 64)])
    nodes = {(r.tree_id, r.node_id): r for r in trees.collect()}
    assert all(r.size == sum(nodes[r.tree_id, r.node_id * 2 + k].size for k in (0, 1)) for r in nodes.values() if r.feature is not None)
    got = {r.invoice_id: r.score for r in iforest.score(m, cols, trees).collect()}
    for row in m.limit(40).collect():
        total = 0.0
        for tree in range(7):
            node, depth = nodes[tree, 1], 0
            while node.feature is not None:
                node, depth = nodes[tree, 2 * node.node_id + (row[cols[node.feature]] > node.threshold)], depth + 1
            total += depth + float(iforest.avg_path_length(node.size))
        want = -(2.0 ** (-total / 7 / float(iforest.avg_path_length(64))))
        assert got[row.invoice_id] == pytest.approx(want, abs=1e-8)


def test_forest_in_blocks_scores_as_in_one(spark):
    m, cols = _toy_matrix(spark, n=700, outliers=3), ["a", "b", "c", "d"]
    m = m.unionByName(m.limit(50))  # ids that repeat stay rows of their own
    runs = [iforest.ForestParams(1, 12, 0.05, 0), iforest.ForestParams(2, 9, 0.1, 64)]
    trees = materialize(iforest.fit(m, cols, runs))
    assert len(iforest.tree_blocks(trees)[0]) == 1 and len(iforest.tree_blocks(trees, 1200)[0]) > 5
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(iforest.score(m, cols, trees)) == rows(iforest.score(m, cols, trees, block_slots=1200))


def test_forest_of_ten_million_nodes_has_no_limit(spark):
    """80 full trees of 2^17 - 1 nodes that all split feature 0 at one half, in blocks of at most 2 million places."""
    inner = F.col("node_id") < (1 << 16)
    trees = spark.range(80 * ((1 << 17) - 1)).select(
        F.lit(1).alias("run_id"), F.expr("cast(id div 131071 as int)").alias("tree_id"), F.expr("id % 131071 + 1").alias("node_id"),
        F.when(inner, 0).alias("feature"), F.when(inner, 0.5).alias("threshold"), F.lit(2).cast("bigint").alias("size"), F.lit(256).cast("bigint").alias("psi"))
    m = spark.createDataFrame([("x", 0.1), ("y", 0.9)], "invoice_id string, a double")
    assert len(iforest.tree_blocks(trees)[0]) == 6
    want = -(2.0 ** (-17 / float(iforest.avg_path_length(256))))
    assert [r.score for r in iforest.score(m, ["a"], trees).collect()] == pytest.approx([want, want])


def test_chunks_rebuild_the_text(spark):
    texts = ["", "a" * 10, "b" * 2000, "".join(chr(65 + i % 26) for i in range(5003)), "é" * 3801]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    ch = documents.chunk_documents(df).toPandas().sort_values(["doc_id", "chunk_idx"])
    for i, t in enumerate(texts):
        parts = ch[ch.doc_id == i].chunk_text.tolist()
        py, start = [], 0
        while start < len(t):
            py.append(t[start:start + 2000])
            if start + 2000 >= len(t):
                break
            start += 1800
        assert parts == py
        if parts:
            assert parts[0] + "".join(p[200:] for p in parts[1:]) == t


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(400, 8))
    labels = rng.integers(0, 3, 400)
    q = rng.normal(size=(4, 8))
    cdf = spark.createDataFrame([(i, [float(v) for v in row], int(lb)) for i, (row, lb) in enumerate(zip(corpus, labels))],
                                "vec_id long, embedding array<double>, label int").repartition(5)
    qdf = spark.createDataFrame([(j, [float(v) for v in row], j % 3) for j, row in enumerate(q)],
                                "query_id int, query_vec array<double>, want int")
    got = vectors.knn_topk(cdf, qdf, 5, corpus_id="vec_id", corpus_filter="label", query_filter="want").toPandas()
    for j in range(4):
        mask = labels == j % 3
        sims = np.round(corpus[mask] @ q[j] / (np.linalg.norm(corpus[mask], axis=1) * np.linalg.norm(q[j])), 4)
        ids = np.nonzero(mask)[0]
        best = sorted(zip(-sims, ids))[:5]
        assert got[got.query_id == j].sort_values("rank").vec_id.tolist() == [int(i) for _, i in best]


def test_prompt_context_empty_and_order(spark):
    qs = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 2, 0.5, "t", "second"), (1, 1, 0.9, "t", "first")],
                                 "query_id int, rank int, similarity double, doc_type string, text string")
    got = {r.query_id: r.context for r in vectors.prompt_context(qs, hits).collect()}
    assert got[1] == "[Source 1 | Type: t | Relevance: 0.9]\nfirst\n\n---\n\n[Source 2 | Type: t | Relevance: 0.5]\nsecond"
    assert got[2] == vectors.NO_CONTEXT


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    lay = L(spark, SF_SMALL)
    topic, out, ckpt = (scratch_path(spark, n) for n in ("topic", "out", "ckpt"))
    ingest.publish_files(lay.raw(), topic, CFG.ingested_at, files=4)
    res = ingest.run_stream_bronze(ingest.file_source(spark, topic, 1), out, ckpt, CFG.ingested_at)
    assert res.batches == 4 and res.rows_read == lay.raw().count()
    streamed = spark.read.parquet(out).drop("_ingested_at", "_source")
    batch = lay.bronze().drop("_ingested_at", "_source")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    again = ingest.run_stream_bronze(ingest.file_source(spark, topic, 1), out, ckpt, CFG.ingested_at)
    assert again.rows_read == 0 and spark.read.parquet(out).count() == res.rows_read


def test_bare_payload_and_envelope_unwrap_alike(spark):
    lay = L(spark, SF_SMALL)
    raw = lay.raw().limit(50)
    env = ingest.envelope(raw, CFG.ingested_at).select("value")
    bare = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    a = ingest.unwrap(env).withColumn("amount", F.when(F.isnan("amount"), None).otherwise(F.col("amount")))
    b = ingest.unwrap(bare)
    assert a.exceptAll(b).count() == 0


def test_pluggable_batch_embedder(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    df = spark.range(120).select(F.col("id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    out = vectors.embed_batches(df.coalesce(1), "text", model, dims=2, batch_size=50).orderBy("id").collect()
    assert [r.embedding for r in out[:2]] == [[6.0, 1.0], [6.0, 1.0]]
    assert len(out) == 120
