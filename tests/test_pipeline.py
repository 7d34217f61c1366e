"""End-to-end compositions: batch medallion run, gated run, model run, retrieval run (written layers)."""

import pytest
from quillspark.config import RunConfig
from quillspark.operators import iforest, quality, vectors
from quillspark.plans import pipeline
from quillspark.plans.catalog_ext import DEMO_QUESTIONS, label_centroids
from quillspark.session import scratch_path
from quillspark.sources.fixtures import raw_invoices
from quillspark.sources.tables import read_table
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def lake(spark):
    root = scratch_path(spark, "e2e")
    cfg = RunConfig(vendor_count=150, category_count=5, month_range=(12, 120), silver_rows=(1000, 15000))
    return root, cfg


def test_gated_run_writes_layers_and_reports(spark, lake):
    root, cfg = lake
    with pytest.raises(quality.QualityGateError):   # the default bounds expect 50 vendors and 7 categories
        pipeline.run_all(spark, raw_invoices(spark, SF_SMALL), root, RunConfig())
    report = pipeline.run_all(spark, raw_invoices(spark, SF_SMALL), root, cfg)
    assert report.count() == 31 and report.where("not passed").count() == 0
    assert spark.read.parquet(f"{root}/vendor_summary").count() == 150
    assert "_created_at" in spark.read.parquet(f"{root}/vendor_summary").columns


def test_model_run(spark, lake):
    root, _ = lake
    runs = [iforest.ForestParams(1, 30, 0.05, 0), iforest.ForestParams(2, 20, 0.08, 128)]
    scores = pipeline.run_ml(spark, root, runs=runs)
    n = scores.count()
    assert n == spark.read.parquet(f"{root}/silver").count()
    r = {x.run_id: x for x in spark.read.parquet(f"{root}/runs").collect()}
    assert r[1].n_anomalies == pytest.approx(0.05 * n, abs=2) and r[2].n_anomalies == pytest.approx(0.08 * n, abs=2)
    assert scores.where("risk_level = 'CRITICAL'").count() == pytest.approx(0.05 * n, abs=2)
    assert spark.read.option("header", True).csv(f"{root}/top_anomalies").count() == 20


def test_retrieval_run(spark, lake):
    root, cfg = lake
    qs = spark.createDataFrame(list(DEMO_QUESTIONS), "query_id int, question string, doc_type string")
    answers = {r.query_id: r for r in pipeline.run_retrieval(spark, root, qs, cfg).collect()}
    assert set(answers) == {1, 2, 3, 4, 5}
    assert answers[1].context.startswith("[Source 1 | Type: vendor_summary")
    assert answers[3].context.count("[Source") == 5


def test_ann_recall_against_exact(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    q = label_centroids(emb)
    exact = vectors.knn_topk(emb, q, 5, corpus_id="vec_id").select("query_id", "vec_id")
    approx = vectors.ann_topk(emb, q, 5, corpus_id="vec_id").select("query_id", "vec_id")
    recall = approx.join(exact, ["query_id", "vec_id"]).count() / exact.count()
    assert recall >= 0.9


def test_production_scoring_reuses_stored_model(spark, lake):
    root, _ = lake
    stored = {r.invoice_id: (r.anomaly_score, r.risk_level) for r in spark.read.parquet(f"{root}/scores").collect()}
    again = {r.invoice_id: (r.anomaly_score, r.risk_level) for r in pipeline.run_scoring(spark, root).collect()}
    assert again.keys() == stored.keys()
    assert all(abs(again[k][0] - stored[k][0]) < 1e-12 and again[k][1] == stored[k][1] for k in stored)


def test_stream_batches_land_in_their_own_folders(spark):
    from quillspark.session import scratch_path
    from quillspark.streaming import ingest
    from quillspark.config import RunConfig
    cfg = RunConfig()
    raw = raw_invoices(spark, SF_SMALL)
    topic, out, ckpt = (scratch_path(spark, n) for n in ("topic", "out", "ckpt"))
    ingest.publish_files(raw, topic, cfg.ingested_at, files=3)
    res = ingest.run_stream_bronze_batches(ingest.file_source(spark, topic, 1), out, ckpt, cfg.ingested_at)
    import os
    assert sorted(d for d in os.listdir(out) if d.startswith("batch_")) == ["batch_000000", "batch_000001", "batch_000002"]
    assert spark.read.parquet(*[f"{out}/batch_{i:06d}" for i in range(3)]).count() == raw.count() == res.rows_read
