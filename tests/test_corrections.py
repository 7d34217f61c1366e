"""Inputs that the driver tables do not hold: long keys, ties, resubmissions, odd CSV, many micro-batches."""

import datetime as dt
import math

import numpy as np
import pytest

from quillspark.config import RunConfig
from quillspark.functions.quantiles import exact_percentiles
from quillspark.operators import documents, iforest, quality, refresh, risk, silver, vectors
from quillspark.plans import pipeline
from quillspark.session import checkpoint_dir, scratch_path
from quillspark.sources import fixtures, io
from quillspark.streaming import ingest
from tests.conftest import SF_SMALL


def test_long_keys_are_not_cut(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(123456789012, 12345678901, 10.0, dt.datetime(1998, 1, 2)), (123456789013, 12345678902, 11.0, dt.datetime(1998, 1, 2))],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(12345678901, 1, "BUILDING"), (12345678902, 1, "BUILDING")],
                          "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(1, "FRANCE")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    rows = fixtures.raw_invoices(spark, d)
    assert sorted(r.invoice_id for r in rows.collect()) == ["INV-123456789012", "INV-123456789013"]
    assert sorted(r.vendor_id for r in rows.collect()) == ["VND-12345678901", "VND-12345678902"]
    scored = risk.fixed_score(rows.withColumn("days_overdue", rows["amount"]))
    want = [((k * 7919) % 1000003 - 50000) / 1000003.0 for k in (123456789012, 123456789013)]
    assert [r.anomaly_score for r in scored.orderBy("invoice_id").collect()] == pytest.approx(want)


def test_amounts_round_like_numpy_and_never_end_the_job(spark):
    values = [0.125, 1.005, 2.675, -0.375, 1e17, 1e27, math.nan, math.inf, None, 0.0, 12345.675]
    rows = silver.fix_amounts(spark.createDataFrame([(v,) for v in values], "amount double")).collect()
    for v, r in zip(values, rows):
        if v is None:
            assert r.amount == 0 and r._amount_was_null
        elif not math.isfinite(v) or abs(v) >= 1e26:
            assert r.amount is None
        else:
            assert float(r.amount) == np.round(abs(v), 2)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_percentiles_take_one_path(spark, n):
    x = np.random.default_rng(n).choice([-math.inf, -1.5, 0.0, 2.0, 3.25, 9.0], n) if n < 100 else np.random.default_rng(n).normal(size=n)
    probs = [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]
    got = exact_percentiles(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", probs, accuracy=100).first()
    with np.errstate(invalid="ignore"):
        want = np.percentile(x, [100 * p for p in probs])
    assert all(a == b or (b != b and (a is None or a != a)) or abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_percentiles_of_a_small_band(spark):
    """The sketch is far coarser than the column: the band must still hold the rank."""
    x = np.random.default_rng(3).normal(size=20_000)
    got = exact_percentiles(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", [0.05, 0.5], accuracy=200).first()
    assert list(got) == pytest.approx(np.percentile(x, [5, 50]).tolist(), abs=1e-12)


def test_csv_as_pandas_reads_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "invoice_id,vendor_id,vendor_name,invoice_date,due_date,amount,status,category,state,notes,created_at\n"
        'I1,V1,"Say ""hi"" co",2020-01-01,2020-02-01,1.5,PAID,x,fr,"two\nlines",t\n'
        "I2,V2,NULL,2020-01-01,N/A,NaN,nan,<NA>,NA,None,#N/A\n"
        "I3,V3, NA ,2020-01-01,,abc,-1.#IND,n/a,null,,\n")
    a, b, c = io.read_raw_csv(spark, str(tmp_path)).orderBy("invoice_id").collect()
    assert (a.vendor_name, a.notes, a.amount) == ('Say "hi" co', "two\nlines", 1.5)
    assert (b.vendor_name, b.due_date, b.amount, b.status, b.category, b.state, b.notes, b.created_at) == (None,) * 8
    assert (c.vendor_name, c.due_date, c.amount, c.status, c.notes) == (" NA ", None, None, None, None)


def test_large_csv_without_line_ends_in_fields_is_split(spark, tmp_path):
    head = "invoice_id,vendor_id,vendor_name,invoice_date,due_date,amount,status,category,state,notes,created_at\n"
    (tmp_path / "a.csv").write_text(head + "".join(f"I{i},V{i % 7},a company,2020-01-01,2020-02-01,{i}.5,PAID,x,fr,note,t\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        split, whole = io.read_raw_csv(spark, str(tmp_path), multiline=False), io.read_raw_csv(spark, str(tmp_path))
        assert split.rdd.getNumPartitions() >= 5 and whole.rdd.getNumPartitions() == 1
        assert split.exceptAll(whole).count() == 0 and split.count() == whole.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chunks_as_one_json_array(spark, tmp_path):
    import json

    rows = [{"doc_id": str(i), "doc_type": "t", "chunk_id": f"{i}_chunk_0", "chunk_text": "a\nb", "chunk_idx": 0, "vendor_id": None} for i in range(5)]
    (tmp_path / "chunks.json").write_text(json.dumps(rows, indent=2))
    got = io.read_chunks_json(spark, str(tmp_path), multiline=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.chunk_text, r.vendor_id) for r in got] == [(str(i), "a\nb", None) for i in range(5)]


def raw_with_resubmissions(spark):
    raw = fixtures.raw_invoices(spark, SF_SMALL)
    again = raw.where("invoice_id like '%7'").withColumn("amount", raw["amount"] + 5)
    other_spelling = raw.where("invoice_id like '%11'").withColumn("vendor_name", raw["status"])
    return raw.unionByName(again).unionByName(other_spelling)


def test_repeated_ids_keep_their_rows(spark):
    root = scratch_path(spark, "repeats")
    pipeline.run_batch(spark, raw_with_resubmissions(spark), root)
    n = spark.read.parquet(f"{root}/silver").count()
    ids = spark.read.parquet(f"{root}/silver").select("invoice_id").distinct().count()
    assert ids < n
    scores = pipeline.run_ml(spark, root, runs=[iforest.ForestParams(1, 10, 0.05)])
    vendors = spark.read.parquet(f"{root}/vendor_summary")
    per_vendor = vendors.groupBy("vendor_id").count().withColumnRenamed("count", "k")
    want = spark.read.parquet(f"{root}/silver").join(per_vendor, "vendor_id").agg({"k": "sum"}).first()[0]
    assert scores.count() == spark.read.parquet(f"{root}/features").count() == want
    assert pipeline.run_scoring(spark, root).count() == want
    qs = spark.createDataFrame([(1, "Which vendors have the highest overdue rates?", "vendor_summary")], "query_id int, question string, doc_type string")
    assert pipeline.run_retrieval(spark, root, qs).first().context.count("[Source") == 5
    assert {"doc_id", "vendor_id", "invoice_id", "risk_level", "year_month", "chunk_text"} <= set(refresh.read(spark, f"{root}/vectors").columns)


def test_a_rebuild_replaces_stale_partitions(spark):
    root = scratch_path(spark, "stale")
    raw = fixtures.raw_invoices(spark, SF_SMALL)
    pipeline.run_batch(spark, raw, root)
    pipeline.run_batch(spark, raw.where("invoice_id = 'INV-000000001'"), root)
    assert spark.read.parquet(f"{root}/silver").count() == 1


def test_a_failed_gate_leaves_its_report(spark):
    root = scratch_path(spark, "gate")
    raw = fixtures.raw_invoices(spark, SF_SMALL).where("invoice_id like '%1'")
    with pytest.raises(quality.QualityGateError):
        pipeline.run_all(spark, raw, root, RunConfig())
    assert spark.read.json(f"{root}/quality_reports/bronze").where("not passed").count() > 0


def test_texts_that_share_an_id_stay_apart(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (2, None), (3, "")], "id int, text string")
    rows = vectors.hashed_bow(df, "id", "text").collect()
    assert [r.id for r in rows] == [1, 1, 2, 3] and rows[0].embedding != rows[1].embedding
    assert sum(rows[2].embedding) == sum(rows[3].embedding) == 0


def test_knn_in_shards_and_blocks_with_two_filters(spark):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(30, 8))
    corpus = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2], i % 3) for i, v in enumerate(x)], "id int, embedding array<double>, kind string, month int")
    queries = spark.createDataFrame([(i, v.tolist(), [None, "a"][i % 2], [None, 1][i // 2 % 2]) for i, v in enumerate(q)],
                                    "query_id int, query_vec array<double>, kind string, month int")
    got = vectors.knn_topk(corpus, queries, 4, corpus_id="id", corpus_filter=["kind", "month"], query_filter=["kind", "month"],
                           shard_rows=40, query_rows=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.id, r.similarity))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, v in enumerate(q):
        s = np.round(1 - (1 - u @ (v / np.linalg.norm(v))), 4)
        ok = [j for j in range(200) if (i % 2 == 0 or j % 2 == 0) and (i // 2 % 2 == 0 or j % 3 == 1)]
        want = sorted(ok, key=lambda j: (-s[j], j))[:4]
        assert [j for _, j, _ in sorted(by[i])] == want


def test_stream_counters_beyond_a_hundred_batches(spark):
    raw = fixtures.raw_invoices(spark, SF_SMALL).limit(110)
    topic, out, ckpt = (scratch_path(spark, n) for n in ("topic", "out", "ckpt"))
    ingest.envelope(raw, dt.datetime(2001, 1, 1)).select("value").repartition(110).write.text(topic)
    res = ingest.run_stream_bronze(ingest.file_source(spark, topic, 1), out, ckpt, dt.datetime(2001, 1, 1))
    assert res.rows_read == spark.read.parquet(out).count() == 110
    assert res.batches == len([1 for _ in spark.sparkContext._jvm.java.io.File(topic).listFiles() if str(_).endswith(".txt") and _.length()])


def test_published_order_within_a_key(spark):
    topic = scratch_path(spark, "topic")
    ingest.publish_files(fixtures.raw_invoices(spark, SF_SMALL), topic, dt.datetime(2001, 1, 1), files=1)
    rows = ingest.unwrap(spark.read.text(topic).coalesce(1)).select("vendor_id", "created_at", "invoice_id").collect()
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in rows)


def test_alerts_have_no_cap(spark):
    rows = [(f"INV-{i}", "V", 1.0, i / 1000, 1, "HIGH") for i in range(300)]
    t = spark.createDataFrame(rows, "invoice_id string, vendor_id string, amount double, anomaly_score double, days_overdue int, risk_level string")
    assert documents.anomaly_documents(t).count() == 300 and documents.anomaly_documents(t, 200).count() == 200


def test_scratch_paths_are_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(checkpoint_dir(spark))
