"""Declarative data-quality checks with gates.

A check is data (name + kind + arguments). All checks of one table compile into ONE
aggregation pass whose single result row is unpivoted to ``(layer, check, passed, detail)``.
Column-existence checks are answered from the schema on the driver without a job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import VALID_STATUSES, RunConfig
from quillspark.functions.exprs import all_true

REPORT_SCHEMA = "layer string, check string, passed boolean, detail string"


@dataclass(frozen=True)
class Check:
    name: str
    kind: str          # exists | no_nulls | all | unique | rows_between | rows_equal
    column: str | None = None
    condition: Column | None = field(default=None, compare=False)
    bounds: tuple = ()
    show_count: bool = False


def _agg_expr(c: Check) -> tuple[Column, Column]:
    """(passed, detail) aggregate expressions for one check."""
    n = F.count(F.lit(1))
    empty = F.lit("")
    if c.kind == "no_nulls":
        return F.count_if(F.col(c.column).isNull()) == 0, empty
    if c.kind == "all":
        return all_true(c.condition), empty
    if c.kind == "unique":
        return (n - F.count_distinct(F.col(c.column))) == 0, empty
    if c.kind == "rows_between":
        lo, hi = c.bounds
        detail = F.concat(F.lit("("), n.cast("string"), F.lit(")")) if c.show_count else empty
        return n.between(lo, hi), detail
    if c.kind == "rows_equal":
        return n == F.lit(c.bounds[0]), empty
    raise ValueError(c.kind)


def evaluate(spark: SparkSession, df: DataFrame, layer: str, checks: list[Check]) -> DataFrame:
    """One aggregation over ``df`` for all data checks; schema checks become literal rows."""
    rows: list[Column] = []
    aggs: list[Column] = []
    for i, c in enumerate(checks):
        if c.kind == "exists":
            rows.append(F.struct(F.lit(layer).alias("layer"), F.lit(c.name).alias("check"),
                                 F.lit(c.column in df.columns).alias("passed"), F.lit("").alias("detail")))
            continue
        passed, detail = _agg_expr(c)
        aggs += [passed.alias(f"__p{i}"), detail.alias(f"__d{i}")]
        rows.append(F.struct(F.lit(layer).alias("layer"), F.lit(c.name).alias("check"),
                             F.col(f"__p{i}").alias("passed"), F.col(f"__d{i}").alias("detail")))
    base = df.agg(*aggs) if aggs else spark.range(1)
    return base.select(F.inline(F.array(*rows)))


def bronze_checks(cfg: RunConfig) -> list[Check]:
    cs = [Check(f"Column {c} exists", "exists", c)
          for c in ("invoice_id", "vendor_id", "vendor_name", "invoice_date", "amount", "status")]
    cs += [Check("invoice_id no nulls", "no_nulls", "invoice_id"),
           Check("vendor_id no nulls", "no_nulls", "vendor_id"),
           Check("Row count ok", "rows_between", bounds=cfg.bronze_rows)]
    cs += [Check(f"Metadata {c}", "exists", c) for c in ("_ingested_at", "_source", "_row_hash")]
    return cs


def silver_checks(cfg: RunConfig) -> list[Check]:
    amount = F.col("amount").cast("double")
    return [
        Check("No null amounts", "no_nulls", "amount"),
        Check("Amounts >= 0", "all", condition=amount >= 0),
        Check("Amounts <= 1M", "all", condition=amount <= cfg.amount_max),
        Check("Valid statuses", "all", condition=F.col("status").isin(*VALID_STATUSES)),
        Check("No null invoice_id", "no_nulls", "invoice_id"),
        Check("No null vendor_id", "no_nulls", "vendor_id"),
        Check("invoice_id unique", "unique", "invoice_id"),
        Check("days_overdue >= 0", "all", condition=F.coalesce(F.col("days_overdue"), F.lit(0)) >= 0),
        Check("Row count ok", "rows_between", bounds=cfg.silver_rows, show_count=True),
    ]


def gold_vendor_checks(cfg: RunConfig) -> list[Check]:
    return [
        Check(f"Vendor count={cfg.vendor_count}", "rows_equal", bounds=(cfg.vendor_count,)),
        Check("No null vendor names", "no_nulls", "vendor_name"),
        Check("total_amounts >= 0", "all", condition=F.col("total_amount") >= 0),
        Check("overdue_rate 0-100", "all", condition=F.col("overdue_rate").between(0, 100)),
        Check("No null risk scores", "no_nulls", "risk_score"),
    ]


def gold_month_checks(cfg: RunConfig) -> list[Check]:
    lo, hi = cfg.month_range
    return [
        Check(f"Month count {lo}-{hi}", "rows_between", bounds=cfg.month_range),
        Check("Monthly totals >= 0", "all", condition=F.col("total_amount") >= 0),
        Check("No null year_month", "no_nulls", "year_month"),
    ]


def gold_category_checks(cfg: RunConfig) -> list[Check]:
    return [
        Check(f"Category count={cfg.category_count}", "rows_equal", bounds=(cfg.category_count,)),
        Check("Category totals >= 0", "all", condition=F.col("total_amount") >= 0),
    ]


def bronze_report(spark, bronze: DataFrame, cfg: RunConfig) -> DataFrame:
    return evaluate(spark, bronze, "bronze", bronze_checks(cfg))


def silver_report(spark, silver: DataFrame, cfg: RunConfig) -> DataFrame:
    return evaluate(spark, silver, "silver", silver_checks(cfg))


def gold_report(spark, vendors: DataFrame, months: DataFrame, categories: DataFrame, cfg: RunConfig) -> DataFrame:
    parts = [evaluate(spark, vendors, "gold", gold_vendor_checks(cfg)),
             evaluate(spark, months, "gold", gold_month_checks(cfg)),
             evaluate(spark, categories, "gold", gold_category_checks(cfg))]
    return reduce(DataFrame.unionByName, parts)


def summary(report: DataFrame) -> DataFrame:
    """Passed / failed per layer plus a ``total`` row."""
    per_layer = report.groupBy("layer").agg(
        F.count_if("passed").cast("bigint").alias("passed"),
        F.count_if(~F.col("passed")).cast("bigint").alias("failed"))
    total = per_layer.agg(F.lit("total").alias("layer"), F.sum("passed").cast("bigint").alias("passed"),
                          F.sum("failed").cast("bigint").alias("failed"))
    return per_layer.unionByName(total)


class QualityGateError(RuntimeError):
    pass


def enforce(report: DataFrame) -> DataFrame:
    """Gate: raise when any check failed. Only failed rows reach the driver (at most the number of checks)."""
    failed = report.where(~F.col("passed")).collect()
    if failed:
        names = ", ".join(f"{r['layer']}:{r['check']}" for r in failed)
        raise QualityGateError(f"{len(failed)} quality check(s) failed: {names}")
    return report
