"""Physical plan shape: pruning and pushdown reach the scans, no cartesian products, Python only where intended."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["vendor_summary", "monthly_trends", "category_analysis", "silver_invoices",
                                 "invoice_features", "chunk_documents", "quality_silver"])
def test_no_python_and_no_cartesian(spark, key):
    p = plan(E.queries()[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_embedding_python_is_only_the_batch_densify(spark):
    p = plan(E.queries()["embed_chunks"](spark, SF_SMALL))
    assert p.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["vendor_summary"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp" in p
    assert "o_orderpriority" not in p and "o_orderstatus" not in p


def test_gold_aggregate_is_partial_then_final(spark):
    p = plan(E.queries()["category_analysis"](spark, SF_SMALL))
    assert "functions=[partial_" in p


def test_filters_pushed_to_parquet(spark):
    from quillspark.sources.tables import read_table
    df = read_table(spark, SF_SMALL, "events").where("value > 10").select("event_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in p
