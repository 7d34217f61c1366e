"""Medallion layers: dedup, silver rules, gold invariants, quality gates, storage round trips."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.config import RunConfig
from quillspark.operators import bronze, gold, quality, silver
from quillspark.plans.catalog import L
from quillspark.plans import pipeline
from quillspark.session import scratch_path
from quillspark.sources import io
from tests.conftest import SF_SMALL

CFG = RunConfig()


def raw_rows(spark, rows):
    from quillspark.streaming.ingest import RAW_SCHEMA
    return spark.createDataFrame(rows, RAW_SCHEMA)


def inv(i, amount=100.0, date="2000-06-15", status="paid", vendor="v-one", vid="VND-1", cat=" misc", state="ca"):
    return (f"INV-{i:06d}", vid, vendor, date, "2000-07-15", amount, status, cat, state, None, "2000-06-15T00:00:00")


def test_dedup_keeps_one_row_per_hash_and_is_idempotent(spark):
    rows = [inv(1), inv(1), inv(1), inv(2), inv(3, amount=None), inv(3, amount=None)]
    b = bronze.add_metadata(raw_rows(spark, rows), CFG.ingested_at)
    once = silver.dedup_keep_first(b)
    assert once.count() == 3
    assert silver.dedup_keep_first(once).count() == 3
    assert sorted(once.columns) == sorted(b.columns)


def test_dedup_hot_key_is_pre_aggregated(spark):
    """A third of all rows share one fingerprint: the plan combines them before the shuffle."""
    rows = [inv(1)] * 300 + [inv(i) for i in range(2, 602)]
    b = bronze.add_metadata(raw_rows(spark, rows), CFG.ingested_at)
    d = silver.dedup_keep_first(b)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate") >= 2          # partial + final
    assert d.count() == 601


def test_silver_rules(spark):
    rows = [inv(1, amount=-50.0, status=" Pending ", date="01/02/2000"),
            inv(2, amount=None, status="PAID", date="15-06-2000"),
            inv(3, status="overdue", date="not-a-date"),
            inv(4, amount=1000.0, status="pending", date="2000-12-31", vendor="o'neil-smith co")]
    s = silver.transform(bronze.add_metadata(raw_rows(spark, rows), CFG.ingested_at), CFG)
    got = {r.invoice_id: r for r in s.collect()}
    assert set(got) == {"INV-000001", "INV-000002", "INV-000004"}        # unparseable date dropped
    r1, r2, r4 = got["INV-000001"], got["INV-000002"], got["INV-000004"]
    assert r1.invoice_date == dt.date(2000, 1, 2) and float(r1.amount) == 50.0 and r1.status == "PENDING"
    assert r2.invoice_date == dt.date(2000, 6, 15) and float(r2.amount) == 0.0 and r2._amount_was_null
    assert r2.days_overdue == 0                                           # PAID forced to 0
    assert r1.is_overdue and r1.days_overdue == (CFG.as_of - dt.date(2000, 7, 15)).days
    assert r4.vendor_name == "O'Neil-Smith Co" and r4.category == "Misc" and r4.state == "CA"
    assert r4.payment_quarter == "Q4" and r4.invoice_year == 2000


def test_diverging_vendor_spelling_fans_out_the_feature_join(spark):
    """Group keys include vendor_name: two real spellings give two summary rows (kept, as the source does)."""
    from quillspark.operators import features
    rows = [inv(1, vendor="Acme"), inv(2, vendor="Acme Corp")]
    s = silver.transform(bronze.add_metadata(raw_rows(spark, rows), CFG.ingested_at), CFG)
    v = gold.vendor_summary(s)
    assert v.count() == 2
    f = features.vendor_features(features.invoice_features(s, ["Misc"]), v)
    assert f.count() == 4


def test_gold_totals_agree_across_tables(spark):
    lay = L(spark, SF_SMALL)
    s = lay.silver()
    tot = lambda df: df.agg(F.sum("total_amount")).first()[0]
    a, b, c = tot(gold.vendor_summary(s)), tot(gold.monthly_trends(s)), tot(gold.category_analysis(s))
    assert a == pytest.approx(b, rel=1e-9) and b == pytest.approx(c, rel=1e-9)
    rates = gold.vendor_summary(s).agg(F.min("overdue_rate"), F.max("overdue_rate")).first()
    assert 0 <= rates[0] <= rates[1] <= 100


def test_quality_report_shape_and_gate(spark):
    lay = L(spark, SF_SMALL)
    rep = quality.silver_report(spark, lay.silver(), CFG)
    rows = rep.collect()
    assert len(rows) == 9
    row_count = [r for r in rows if r.check == "Row count ok"][0]
    assert row_count.detail.startswith("(")
    with pytest.raises(quality.QualityGateError):
        quality.enforce(quality.gold_report(spark, lay.vendor_summary(), lay.monthly_trends(),
                                            lay.category_analysis(), CFG))   # 150 vendors != 50
    ok_cfg = RunConfig(silver_rows=(1, 10**9))
    quality.enforce(quality.evaluate(spark, lay.silver(), "silver",
                                     [c for c in quality.silver_checks(ok_cfg) if c.name != "invoice_id unique"]))


def test_silver_write_is_idempotent_and_prunes_partitions(spark):
    root = scratch_path(spark, "lake-test")
    pipeline.batch_from_tables(spark, SF_SMALL, root)
    first = spark.read.parquet(f"{root}/silver").count()
    pipeline.batch_from_tables(spark, SF_SMALL, root)                     # rerun
    assert spark.read.parquet(f"{root}/silver").count() == first
    q = spark.read.parquet(f"{root}/silver").where("invoice_year = 1998 and payment_quarter = 'Q2'")
    plan = q._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "invoice_year" in filters and "payment_quarter" in filters
    assert q.count() > 0


def test_sources_and_sinks_round_trip(spark):
    lay = L(spark, SF_SMALL)
    base = scratch_path(spark, "io-test")
    raw = lay.raw()
    raw.write.mode("overwrite").option("header", True).csv(f"{base}/csv")
    back = io.read_raw_csv(spark, f"{base}/csv")
    assert back.count() == raw.count()
    assert back.where("amount is null").count() == raw.where("amount is null").count()
    io.write_bronze(bronze.add_metadata(raw, CFG.ingested_at), f"{base}/bronze/batch1")
    io.write_bronze(bronze.add_metadata(raw, CFG.ingested_at), f"{base}/bronze/nested/batch2")
    assert io.read_parquet_tree(spark, f"{base}/bronze").count() == 2 * raw.count()
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        io.read_parquet_tree(spark, f"{base}/missing").count()
