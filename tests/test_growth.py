"""What one task holds does not grow with the input."""

import datetime as dt
import hashlib
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from quillspark.operators import cells, vectors
from quillspark.session import materialize, scratch_path
from quillspark.sources import fixtures
from quillspark.streaming import ingest
from tests.conftest import SF_SMALL
from tests.test_plans import plan


def test_a_published_file_is_bounded_and_batches_stay(spark):
    """Each file is sorted by one task: more messages are more files, and as many micro-batches as before."""
    topic, now = scratch_path(spark, "topic"), dt.datetime(2001, 1, 1)
    raw = fixtures.raw_invoices(spark, SF_SMALL)
    n = raw.count()
    parts = ingest.publish_files(raw, topic, now, files=3, file_rows=100)
    assert parts == -(-n // 300) > 1
    lines = spark.read.text(topic).select(F.input_file_name().alias("f"), F.get_json_object("value", "$.payload.vendor_id").alias("key"))
    rows = [r["count"] for r in lines.groupBy("f").count().collect()]
    assert sum(rows) == n and len(rows) == 3 * parts and max(rows) < n / 3 / 2
    assert lines.groupBy("key").agg(F.countDistinct("f").alias("files")).where("files > 1").count() == 0
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    res = ingest.run_stream_bronze(ingest.file_source(spark, topic, max_files=parts), out, ckpt, now)
    assert (res.batches, res.rows_read) == (3, n)
    assert ingest.publish_files(raw, scratch_path(spark, "topic"), now, files=3, max_messages=100) == 1


def test_a_token_is_hashed_once_and_counts_are_those_of_the_pattern(monkeypatch):
    texts = ["a1 a1 b", "", "x", "x y", " z", "z ", "...", "w\u00f6rld \u65e5a\u672c", "a-b_c"] * 3
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for w in re.findall("[a-z0-9]+", t):
            want[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    seen, bucket = [], vectors.token_bucket
    monkeypatch.setattr(vectors, "token_bucket", lambda token, dims: seen.append(token) or bucket(token, dims))
    assert (vectors.bucket_counts(pa.array(texts), 64) == want).all()
    assert len(seen) == len(set(seen)) == len({w for t in texts for w in re.findall("[a-z0-9]+", t)})
    assert vectors.bucket_counts(pa.array(["", "-"]), 64).sum() == 0 and vectors.bucket_counts(pa.array([], pa.string()), 64).shape == (0, 64)


def test_the_rebuilt_vectors_are_made_once(spark):
    assert plan(E.queries()["vector_refresh"](spark, SF_SMALL)).count("ArrowEvalPython") == 1


def test_scoring_makes_silver_once(spark, monkeypatch):
    """Silver is a pass over all orders and a shuffle: one scan of them, however often its rows are read."""
    from quillspark.plans import catalog_ext as ext
    written = []
    monkeypatch.setattr(ext, "materialize", lambda df: written.append(plan(df)) or materialize(df))
    ext.q_scoring_rows(spark, SF_SMALL)
    assert [p.count("orders.parquet") for p in written][:1] == [1] and not any("orders.parquet" in p for p in written[1:])


def test_invoices_sent_again_are_those_of_a_union(spark):
    from quillspark.plans import catalog_ext as ext
    silver = ext.L(spark, SF_SMALL).silver()
    again = silver.where("payment_quarter = 'Q1'").withColumn("amount", F.expr("CAST(amount + 1 AS DECIMAL(28,2))"))
    rows = lambda df: sorted(map(str, df.select(*ext.SCORED_COLUMNS).collect()))
    assert rows(ext._sent_again(silver)) == rows(silver.unionByName(again))


def test_similarities_are_worked_on_in_tiles(monkeypatch):
    """4,000 queries against 4,000 rows: a whole matrix of 128 MB, and copies of it, are never held; tiles change no answer."""
    rng = np.random.default_rng(3)
    x, ids, kinds = cells.unit(rng.normal(size=(4000, 8))), rng.permutation(4000), pd.Series(rng.integers(0, 3, 4000))
    tracemalloc.start()
    got = cells.best_rows(np.arange(4000), x, [kinds], ids, x, [kinds], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 125_000_000 and len(got[0]) == 20_000
    monkeypatch.setattr(cells, "TILE", 10**9)
    assert all((a == b).all() for a, b in zip(got, cells.best_rows(np.arange(4000), x, [kinds], ids, x, [kinds], 5)))


def test_wanted_cells_come_in_pieces(spark, monkeypatch):
    """Queries that want every cell: their repeated rows leave in pieces, none is lost."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    index = cells.build_cells(df, "vec_id", "embedding")
    asked = cells._asked(df.selectExpr("vec_id query_id", "embedding query_vec"), "query_id", "query_vec", ())
    monkeypatch.setattr(cells, "TILE", 100)
    monkeypatch.setattr(cells, "WANTED_BYTES", 640)
    wanted = cells.wanted_cells(index, asked, len(index.centres))
    assert wanted.count() == 400 * (index.sizes[:-1] > 0).sum() == wanted.select("query_id", "cell").distinct().count()


def test_rows_of_a_few_runs_are_not_dealt_by_run(spark, monkeypatch):
    """Scores of three runs meet the bounds of their percentiles where they lie, not in three tasks."""
    from quillspark.functions import quantiles
    scores = spark.range(3000).selectExpr("cast(id % 3 as int) run_id", "cast(id as double) score")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(quantiles._attach(scores, scores.groupBy("run_id").agg(F.max("score").alias("top")), ["run_id"], few_groups=True))
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
        assert sorted(tuple(r) for r in quantiles.exact_percentiles(scores, "score", [0.5], by=["run_id"], few_groups=True).collect()) == [
            (0, 1498.5), (1, 1499.5), (2, 1500.5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
