"""Gold layer: vendor, month and category summaries plus the small reports read off silver.

Every summary is a single ``groupBy().agg()``: Spark plans a partial (map-side) aggregate,
one hash exchange on the group key and a final aggregate, so hot keys are combined before
the shuffle. Rates and rounding follow pandas (see ``np_round``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import np_round, rate_pct

VENDOR_KEYS = ("vendor_id", "vendor_name", "state")


def _status_count(name: str) -> F.Column:
    return F.count_if(F.col("status") == name).cast("bigint")


def _money_stats() -> list[F.Column]:
    amount = F.col("amount")
    return [F.count("invoice_id").cast("bigint").alias("total_invoices"),
            F.sum(amount).alias("__sum"),
            F.count(amount).alias("__cnt")]


def _finish_money(df: DataFrame) -> DataFrame:
    """total_amount = round(sum, 2); avg_amount = round(sum / count, 2) in double like pandas' mean."""
    total = F.col("__sum").cast("double")
    return (df.withColumn("total_amount", np_round(total, 2))
              .withColumn("avg_amount", np_round(F.try_divide(total, F.col("__cnt").cast("double")), 2))
              .drop("__sum", "__cnt"))


def vendor_summary(silver: DataFrame) -> DataFrame:
    """Per (vendor_id, vendor_name, state): counts, money, status counts, rates, risk score; largest total first."""
    g = silver.groupBy(*VENDOR_KEYS).agg(
        *_money_stats(),
        F.max("amount").cast("double").alias("max_amount"),
        _status_count("PAID").alias("paid_count"),
        _status_count("OVERDUE").alias("overdue_count"),
        _status_count("DISPUTED").alias("disputed_count"),
        _status_count("PENDING").alias("pending_count"),
        F.avg(F.col("days_overdue").cast("double")).alias("avg_days_overdue"),
    )
    g = _finish_money(g)
    out = (g.withColumn("payment_rate", rate_pct("paid_count", "total_invoices"))
             .withColumn("overdue_rate", rate_pct("overdue_count", "total_invoices"))
             .withColumn("dispute_rate", rate_pct("disputed_count", "total_invoices"))
             .withColumn("risk_score", np_round(F.col("overdue_rate") * 0.6 + F.col("dispute_rate") * 0.4, 2)))
    return out.select(*VENDOR_KEYS, "total_invoices", "total_amount", "avg_amount", "max_amount",
                      "paid_count", "overdue_count", "disputed_count", "pending_count", "avg_days_overdue",
                      "payment_rate", "overdue_rate", "dispute_rate", "risk_score")


def order_by_total(df: DataFrame, *tie: str) -> DataFrame:
    """Largest total first; ties broken by the keys so the order is total (a global sort: use for output only)."""
    return df.orderBy(F.col("total_amount").desc(), *[F.col(t).asc() for t in tie])


def monthly_trends(silver: DataFrame) -> DataFrame:
    """Per ``yyyy-MM``: counts, money, status counts, overdue rate and month-over-month change of the total.

    The ``lag`` window has no partition key, but it runs on the aggregated table (one row per
    month present), never on invoice rows, so its single task holds at most a few hundred rows.
    """
    g = silver.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("year_month")).agg(
        *_money_stats(),
        _status_count("PAID").alias("paid_count"),
        _status_count("OVERDUE").alias("overdue_count"),
        _status_count("DISPUTED").alias("disputed_count"),
    )
    g = _finish_money(g).withColumn("overdue_rate", rate_pct("overdue_count", "total_invoices"))
    prev = F.lag("total_amount").over(Window.orderBy("year_month"))
    mom = np_round(F.try_divide(F.col("total_amount"), F.nullif(prev, F.lit(0.0))) - F.lit(1.0), 4) * F.lit(100.0)
    return g.withColumn("amount_mom_change", mom).select(
        "year_month", "total_invoices", "total_amount", "avg_amount", "paid_count", "overdue_count",
        "disputed_count", "overdue_rate", "amount_mom_change")


def category_analysis(silver: DataFrame) -> DataFrame:
    """Per category: counts, money, overdue/disputed counts, exact distinct vendors, rates."""
    g = silver.groupBy("category").agg(
        *_money_stats(),
        _status_count("OVERDUE").alias("overdue_count"),
        _status_count("DISPUTED").alias("disputed_count"),
        F.count_distinct("vendor_id").cast("bigint").alias("unique_vendors"),
    )
    g = _finish_money(g)
    return (g.withColumn("overdue_rate", rate_pct("overdue_count", "total_invoices"))
             .withColumn("dispute_rate", rate_pct("disputed_count", "total_invoices"))
             .select("category", "total_invoices", "total_amount", "avg_amount", "overdue_count",
                     "disputed_count", "unique_vendors", "overdue_rate", "dispute_rate"))


def top_vendor(vendors: DataFrame) -> DataFrame:
    """The vendor with the largest total (ties by id). ``limit`` after ``orderBy`` plans a
    TakeOrderedAndProject: each task keeps its best row, no full sort."""
    return order_by_total(vendors, *VENDOR_KEYS).limit(1).select(*VENDOR_KEYS, "total_amount")


def status_breakdown(silver: DataFrame) -> DataFrame:
    return silver.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def silver_profile(silver: DataFrame) -> DataFrame:
    return silver.agg(
        F.count(F.lit(1)).cast("bigint").alias("clean_records"),
        F.min("amount").cast("double").alias("min_amount"),
        F.max("amount").cast("double").alias("max_amount"),
        F.count_if("is_overdue").cast("bigint").alias("overdue_invoices"),
    )


def gold_totals(silver: DataFrame) -> DataFrame:
    """Run summary: number of vendors, months and categories, total value, overall overdue % (1 decimal).

    Silver is combined per vendor, month and category first (one hash aggregation); the exact distinct counts, which
    expand every row once each, then see those few rows only.
    """
    small = silver.groupBy(*VENDOR_KEYS, F.date_format("invoice_date", "yyyy-MM").alias("month"), "category").agg(
        F.sum("amount").alias("value"), F.count("status").alias("known"), F.count_if(F.col("status") == "OVERDUE").alias("overdue"))
    return small.agg(
        F.count_distinct(*[F.col(c) for c in VENDOR_KEYS]).cast("bigint").alias("vendors_tracked"),
        F.count_distinct("month").cast("bigint").alias("months_of_data"),
        F.count_distinct("category").cast("bigint").alias("categories_analyzed"),
        F.sum("value").cast("double").alias("total_invoice_value"),
        np_round(F.try_divide(F.sum("overdue").cast("double"), F.sum("known")) * F.lit(100.0), 1).alias("overall_overdue_pct"),
    )


def duplicate_ids(silver: DataFrame) -> DataFrame:
    """Rows whose invoice_id already occurred (``duplicated().sum()``) = count - count distinct."""
    return silver.agg((F.count(F.lit(1)) - F.count_distinct("invoice_id")).cast("bigint").alias("duplicate_invoice_ids"))
