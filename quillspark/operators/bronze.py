"""Bronze layer: raw rows plus ingestion metadata and a row fingerprint. Nothing else changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import BATCH_SOURCE
from quillspark.functions.exprs import nan_to_null, row_hash


def add_metadata(raw: DataFrame, ingested_at: dt.datetime, source: str = BATCH_SOURCE) -> DataFrame:
    """``_ingested_at`` (a run parameter, not the wall clock), ``_source`` and ``_row_hash``.

    One projection, fused into the scan's codegen stage. Amount NaN is normalised to null
    first, the way pandas treats NaN as missing.
    """
    df = raw.withColumn("amount", nan_to_null("amount")) if "amount" in raw.columns else raw
    return df.select(
        "*",
        F.lit(ingested_at).cast("timestamp").alias("_ingested_at"),
        F.lit(source).alias("_source"),
        row_hash("invoice_id", "amount", "invoice_date").alias("_row_hash"),
    )


def ingest_stats(df: DataFrame) -> DataFrame:
    """Row count and null count per column in ONE aggregation pass, unpivoted to (column_name, null_count, total_records)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__null_{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__null_{i}").cast("bigint").alias("null_count"))
                      for i, c in enumerate(cols)])
    return (agg.select(F.col("__n").cast("bigint").alias("total_records"), F.explode(pairs).alias("p"))
            .select(F.col("p.column_name").alias("column_name"), F.col("p.null_count").alias("null_count"), "total_records"))
