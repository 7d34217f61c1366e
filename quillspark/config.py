"""Run parameters. Everything that the reference took from the wall clock is a parameter here."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Fixed values that must equal the reference's for equal results.
VALID_STATUSES = ("PAID", "PENDING", "OVERDUE", "DISPUTED", "CANCELLED")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy")
BATCH_SOURCE = "invoice_csv_feed"
STREAM_SOURCE = "kafka_stream"
EVENT_TYPE = "INVOICE_RECEIVED"
EVENT_SOURCE_SYSTEM = "invoice_feed_v1"
# 500 "tokens" of 4 characters, 50 tokens of overlap.
CHUNK_CHARS = 2000
CHUNK_OVERLAP_CHARS = 200
TOP_K = 5
# Experiment grid of the anomaly model (trees, contamination, max_samples; 0 = auto).
FOREST_EXPERIMENTS = (
    (100, 0.05, 0),
    (200, 0.08, 0),
    (150, 0.05, 256),
)
FOREST_SEED = 42
MODEL_FEATURES = (
    "amount", "amount_zscore", "amount_log", "is_round_amount",
    "days_overdue", "invoice_month", "invoice_dow", "is_weekend",
    "invoice_quarter", "status_PAID", "status_PENDING", "status_OVERDUE",
    "status_DISPUTED", "status_CANCELLED", "vendor_total_invoices",
    "vendor_avg_amount", "vendor_overdue_rate", "vendor_dispute_rate",
    "vendor_risk_score", "amount_vs_vendor_avg",
)


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one pipeline run.

    ``as_of`` replaces "today" of the silver layer; ``ingested_at`` replaces the
    ingestion wall clock so that reruns give identical bronze rows.
    """

    as_of: dt.date = dt.date(2001, 1, 1)
    ingested_at: dt.datetime = dt.datetime(2001, 1, 1, 0, 0, 0)
    date_formats: tuple[str, ...] = DATE_FORMATS
    # quality bounds (the reference's fixed numbers are defaults)
    bronze_rows: tuple[int, int] = (1000, 100000)
    silver_rows: tuple[int, int] = (1000, 15000)
    amount_max: float = 1_000_000.0
    vendor_count: int = 50
    month_range: tuple[int, int] = (12, 36)
    category_count: int = 7
    high_risk_score: float = 10.0
    elevated_overdue_rate: float = 15.0
    anomaly_doc_cap: int | None = None
