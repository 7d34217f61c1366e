"""Deterministic raw invoices derived from the driver tables.

The reference's raw invoice file is not available, so the dirt it expects (three date
formats, missing and negative amounts, odd casing and blanks, repeated rows) is produced
as a projection over orders x customer x nation keyed by ``k = o_orderkey``.
The rules are the fixture contract in FIXTURES.md; they are the data definition,
not a sampling of the input: every order becomes an invoice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import read_table


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw invoice rows with the 11 source columns, all as the source system would send them."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded by definition.
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    base = (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"),
                    F.col("o_totalprice").alias("p"), "c_custkey", "c_mktsegment", "n_name"))

    one = base.selectExpr(
        "k",
        "concat('INV-', lpad(CAST(k AS STRING), greatest(9, length(CAST(k AS STRING))), '0')) AS invoice_id",
        "concat('VND-', lpad(CAST(c_custkey AS STRING), greatest(7, length(CAST(c_custkey AS STRING))), '0')) AS vendor_id",
        "CASE WHEN k % 2 = 0 THEN concat(' VENDOR-GROUP ', CAST(c_custkey AS STRING), ' O''NEIL AND SONS ') "
        "ELSE concat('vendor-group ', CAST(c_custkey AS STRING), ' o''neil and sons') END AS vendor_name",
        "CASE WHEN k % 211 = 0 THEN 'not-a-date' WHEN k % 3 = 0 THEN date_format(d, 'yyyy-MM-dd') "
        "WHEN k % 3 = 1 THEN date_format(d, 'MM/dd/yyyy') ELSE date_format(d, 'dd-MM-yyyy') END AS invoice_date",
        "date_format(date_add(d, 30), 'yyyy-MM-dd') AS due_date",
        "CAST(CASE WHEN k % 33 = 0 THEN NULL WHEN k % 97 = 0 THEN floor(p / 1000) * 1000 "
        "WHEN k % 100 = 7 THEN -p ELSE p END AS DOUBLE) AS amount",
        "CASE WHEN k % 20 < 11 THEN 'paid' WHEN k % 20 < 16 THEN 'Pending ' WHEN k % 20 < 18 THEN ' OVERDUE' "
        "WHEN k % 20 = 18 THEN 'Disputed' ELSE 'cancelled' END AS status",
        "CASE WHEN k % 2 = 0 THEN lower(c_mktsegment) ELSE concat(' ', c_mktsegment) END AS category",
        "lower(n_name) AS state",
        "CASE WHEN k % 10 < 7 THEN concat('note ', CAST(k AS STRING)) END AS notes",
        "concat(date_format(d, 'yyyy-MM-dd'), 'T', lpad(CAST(floor((k % 86400) / 3600) AS STRING), 2, '0'), ':', "
        "lpad(CAST(floor((k % 3600) / 60) AS STRING), 2, '0'), ':', lpad(CAST(k % 60 AS STRING), 2, '0')) AS created_at",
    )
    # rows with k % 50 = 0 are re-sent once (the 2% duplicates of the source feed); one pass, no second scan
    return one.select("*", F.expr("explode(sequence(1, CASE WHEN k % 50 = 0 THEN 2 ELSE 1 END))").alias("_copy")) \
        .drop("k", "_copy")


RAW_COLUMNS = ("invoice_id", "vendor_id", "vendor_name", "invoice_date", "due_date", "amount",
               "status", "category", "state", "notes", "created_at")
