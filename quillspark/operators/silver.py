"""Silver layer: dedup, date unification, amount repair, text standardisation, derived due/overdue facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import RunConfig
from quillspark.functions.exprs import parse_date, py_strip_sql, ref, title_case_sql

SILVER_PARTITIONS = ("invoice_year", "payment_quarter")


def dedup_keep_first(df: DataFrame, key: str = "_row_hash",
                     order: Sequence[str] = ("_ingested_at", "created_at", "invoice_id"), count_as: str | None = None) -> DataFrame:
    """Keep one row per ``key``: the first by ``order`` (then by every other column, so the pick is total).

    Written as an aggregation (``min`` of a struct led by the ordering columns) rather than
    ``row_number`` over a window: the aggregation combines map-side before the shuffle, so a key
    that holds a third of all rows (a feed that re-sends the same record) collapses to one row
    per task instead of meeting in a single one. ``count_as`` adds the number of rows of the key.
    """
    rest = [c for c in df.columns if c != key]
    ordering = [c for c in order if c in rest] + [c for c in rest if c not in order]
    first = F.expr("min(struct(" + ", ".join(ref(c) for c in ordering) + "))")
    counts = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    return df.groupBy(key).agg(first.alias("__row"), *counts).selectExpr(
        *[ref(c) if c == key else f"__row.{ref(c)} AS {ref(c)}" for c in df.columns], *([ref(count_as)] if count_as else []))


def standardize_dates(df: DataFrame, formats: Sequence[str]) -> DataFrame:
    """All accepted formats to one DateType; rows whose invoice_date cannot be parsed are dropped."""
    return (df.withColumn("invoice_date", parse_date("invoice_date", formats))
              .withColumn("due_date", parse_date("due_date", formats))
              .where(F.col("invoice_date").isNotNull()))


def fix_amounts(df: DataFrame) -> DataFrame:
    """Flag missing amounts, fill with 0, make positive, round to 2 decimals as numpy does (ties of the scaled
    double to even) and keep the result as exact money. decimal(28,2) holds any amount below 1e26; larger ones,
    NaN and infinities become null instead of ending the job."""
    a = f"CAST({ref('amount')} AS DOUBLE)"
    return (df.withColumn("_amount_was_null", F.expr(f"{a} IS NULL"))
              .withColumn("amount", F.expr(f"try_cast(rint(abs(coalesce({a}, 0.0D)) * 100.0D) / 100.0D AS DECIMAL(28,2))")))


def standardize_text(df: DataFrame) -> DataFrame:
    """status, state: upper + strip; category, vendor_name: Python title case + strip."""
    return (df.withColumn("status", F.expr(py_strip_sql(f"upper({ref('status')})")))
              .withColumn("category", F.expr(py_strip_sql(title_case_sql(ref("category")))))
              .withColumn("vendor_name", F.expr(py_strip_sql(title_case_sql(ref("vendor_name")))))
              .withColumn("state", F.expr(py_strip_sql(f"upper({ref('state')})"))))


def add_derived_columns(df: DataFrame, as_of: dt.date) -> DataFrame:
    """days_to_due, days_overdue (0 for PAID, never negative, null when the due date is unknown),
    is_overdue, payment_quarter ("Q1".."Q4"), invoice_year."""
    d = f"DATE'{as_of.isoformat()}'"
    return df.selectExpr(
        "*",
        "datediff(due_date, invoice_date) AS days_to_due",
        f"CASE WHEN status = 'PAID' THEN 0 WHEN due_date IS NULL THEN CAST(NULL AS INT) "
        f"ELSE greatest(datediff({d}, due_date), 0) END AS days_overdue",
        f"coalesce(status = 'OVERDUE' OR (due_date < {d} AND status IN ('PENDING')), false) AS is_overdue",
        "concat('Q', CAST(quarter(invoice_date) AS STRING)) AS payment_quarter",
        "CAST(year(invoice_date) AS INT) AS invoice_year",
    )


def transform(bronze: DataFrame, cfg: RunConfig) -> DataFrame:
    """bronze -> silver. After the dedup shuffle everything is one Project + Filter stage."""
    df = dedup_keep_first(bronze)
    df = standardize_dates(df, cfg.date_formats)
    df = fix_amounts(df)
    df = standardize_text(df)
    df = add_derived_columns(df, cfg.as_of)
    return df.withColumn("_processed_at", F.lit(cfg.ingested_at).cast("timestamp"))


def silver_audit(bronze: DataFrame, cfg: RunConfig) -> DataFrame:
    """Counters the silver step reports: rows before/after dedup, duplicates removed, unparseable dates
    dropped, null amounts filled, negative amounts fixed. One pass: the dedup aggregation also counts the
    rows of each key, and one aggregation over its rows gives all counters."""
    deduped = dedup_keep_first(bronze, count_as="__copies")
    idate = parse_date("invoice_date", cfg.date_formats)
    amt = F.col("amount").cast("double")
    kept = idate.isNotNull()
    totals = deduped.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("before_dedup"),
        F.count(F.lit(1)).alias("after_dedup"),
        F.count_if(~kept).alias("dropped_unparseable"),
        F.count_if(kept & amt.isNull()).alias("filled_null_amounts"),
        F.count_if(kept & (amt < 0)).alias("fixed_negative_amounts"),
    )
    return totals.select(
        F.col("before_dedup").cast("bigint").alias("before_dedup"),
        F.col("after_dedup").cast("bigint").alias("after_dedup"),
        (F.col("before_dedup") - F.col("after_dedup")).cast("bigint").alias("duplicates_removed"),
        F.col("dropped_unparseable").cast("bigint").alias("dropped_unparseable"),
        F.col("filled_null_amounts").cast("bigint").alias("filled_null_amounts"),
        F.col("fixed_negative_amounts").cast("bigint").alias("fixed_negative_amounts"),
    )
