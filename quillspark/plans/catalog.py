"""Query catalog: one key per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.config import RunConfig
from quillspark.operators import bronze as bronze_ops
from quillspark.operators import gold as gold_ops
from quillspark.operators import silver as silver_ops
from quillspark.plans.layers import Layers, silver_output

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


def L(spark: SparkSession, sf_dir: str, shared: bool = False) -> Layers:
    return Layers(spark, sf_dir, RunConfig(), shared=shared)


# --- bronze / silver -----------------------------------------------------------------------
@query("raw_invoices")
def q_raw(spark, sf_dir):
    return L(spark, sf_dir).raw()


@query("bronze_invoices")
def q_bronze(spark, sf_dir):
    return L(spark, sf_dir).bronze().drop("_ingested_at")


@query("silver_invoices")
def q_silver(spark, sf_dir):
    return silver_output(L(spark, sf_dir).silver())


@query("silver_audit")
def q_silver_audit(spark, sf_dir):
    lay = L(spark, sf_dir)
    return silver_ops.silver_audit(lay.bronze(), lay.cfg)


@query("ingest_stats")
def q_ingest_stats(spark, sf_dir):
    return bronze_ops.ingest_stats(L(spark, sf_dir).bronze())


# --- gold ----------------------------------------------------------------------------------
@query("vendor_summary")
def q_vendor_summary(spark, sf_dir):
    return L(spark, sf_dir).vendor_summary()


@query("monthly_trends")
def q_monthly_trends(spark, sf_dir):
    return L(spark, sf_dir).monthly_trends()


@query("category_analysis")
def q_category_analysis(spark, sf_dir):
    return L(spark, sf_dir).category_analysis()


@query("top_vendor")
def q_top_vendor(spark, sf_dir):
    return gold_ops.top_vendor(L(spark, sf_dir).vendor_summary())


@query("status_breakdown")
def q_status_breakdown(spark, sf_dir):
    return gold_ops.status_breakdown(L(spark, sf_dir).silver())


@query("silver_profile")
def q_silver_profile(spark, sf_dir):
    return gold_ops.silver_profile(L(spark, sf_dir).silver())


@query("gold_totals")
def q_gold_totals(spark, sf_dir):
    return gold_ops.gold_totals(L(spark, sf_dir).silver())


@query("duplicate_ids")
def q_duplicate_ids(spark, sf_dir):
    return gold_ops.duplicate_ids(L(spark, sf_dir).silver())
