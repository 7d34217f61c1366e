"""Readers and writers of the lake layers.

Readers use fixed schemas (no inference pass over the data); writers are idempotent
(overwrite, or dynamic partition overwrite for the partitioned silver layer).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.silver import SILVER_PARTITIONS
from quillspark.streaming.ingest import RAW_SCHEMA

# The spellings that pandas.read_csv takes for a missing value by default.
NA_SPELLINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

CHUNK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("doc_type", T.StringType()),
    T.StructField("vendor_id", T.StringType()), T.StructField("invoice_id", T.StringType()),
    T.StructField("risk_level", T.StringType()), T.StructField("year_month", T.StringType()),
    T.StructField("chunk_id", T.StringType()), T.StructField("chunk_text", T.StringType()),
    T.StructField("chunk_idx", T.IntegerType()),
])


# --- sources -------------------------------------------------------------------------------
def read_raw_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Header CSV with the raw invoice schema, read as pandas reads it: doubled quotes inside quotes, line ends
    inside quotes, and empty fields or NA spellings in any column are null. An amount that is no number is null.

    A file whose fields may hold line ends is read by one task. Where none does, ``multiline=False`` lets
    Spark split large files among tasks."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA])
    rows = (spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("mode", "PERMISSIVE").csv(path))
    known = [F.when(~F.col(f.name).isin(*NA_SPELLINGS), F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in RAW_SCHEMA]
    return rows.select(*known)


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.parquet`` below ``path`` (any depth) as one table; schemas of the parts are merged.

    Recursive lookup turns partition discovery off: use ``read_partitioned`` for hive layouts.
    A path without files raises (AnalysisException), like the source's "no parquet files" error.
    """
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .option("mergeSchema", True).parquet(path))


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Hive-partitioned table (partition columns discovered; filters on them prune directories)."""
    return spark.read.parquet(path)


def read_chunks_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Chunk records as JSON lines (or one JSON array per file with ``multiline``)."""
    return spark.read.schema(CHUNK_SCHEMA).option("multiLine", multiline).json(path)


# --- sinks ---------------------------------------------------------------------------------
def write_bronze(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_silver(df: DataFrame, path: str, full: bool = True) -> None:
    """Partitioned by invoice_year / payment_quarter. ``full`` replaces the table, so that partitions a rebuild
    no longer produces do not stay; else only the partitions present in ``df`` are replaced (dynamic overwrite).

    A rebalance on the partition columns sizes the writing tasks by bytes at run time (AQE's advisory size): a
    quarter is written by as many tasks as its data need, small quarters share one.
    """
    (df.hint("rebalance", *[F.col(c) for c in SILVER_PARTITIONS]).write.mode("overwrite")
       .option("partitionOverwriteMode", "static" if full else "dynamic").partitionBy(*SILVER_PARTITIONS).parquet(path))


def write_gold(df: DataFrame, path: str, created_at: dt.datetime) -> None:
    """A gold table with ``_created_at``. No ``coalesce(1)``: the vendor table grows with the data and a
    coalesce would also pull the final aggregate into one task; AQE merges small output partitions."""
    df.withColumn("_created_at", F.lit(created_at).cast("timestamp")).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Features, scores, trees, runs: plain Parquet, overwrite."""
    df.write.mode("overwrite").parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small report (e.g. top anomalies) as one header CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (chunks, answers, quality reports)."""
    df.write.mode("overwrite").json(path)

