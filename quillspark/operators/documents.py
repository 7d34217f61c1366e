"""Text documents from gold / scored rows and overlapping character chunks.

Documents are column expressions (``concat`` + ``when``), not per-row Python. Chunking is
``explode(sequence(...))`` + ``substring``: each document is cut where it lives, whole, with
no shuffle; the longest text only changes the number of output rows of its own task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import CHUNK_CHARS, CHUNK_OVERLAP_CHARS
from quillspark.functions.exprs import money_text, py_float_text

DOC_COLUMNS = ("doc_id", "doc_type", "vendor_id", "invoice_id", "risk_level", "year_month", "text")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Fixed texts of the three document templates (must equal the source wording).
VENDOR_HIGH = "High risk vendor requiring attention."
VENDOR_LOW = "Low to medium risk vendor."
ANOMALY_ZERO = "Zero dollar amount detected - possible data entry error or fraudulent submission."
ANOMALY_OTHER = "Unusual pattern detected compared to vendor historical behavior."
ACTION_CRITICAL = "Immediate review required."
ACTION_OTHER = "Review within 48 hours."
TREND_ELEVATED = "Elevated overdue rate this month - collections team should be alerted."
TREND_NORMAL = "Overdue rate within normal range."


def vendor_documents(vendors: DataFrame, high_risk: float = 10.0) -> DataFrame:
    """One report per vendor summary row; the assessment sentence depends on risk_score > ``high_risk``."""
    text = _lines(
        "Vendor Report: ", _s("vendor_name"), "\nVendor ID: ", _s("vendor_id"), "\nState: ", _s("state"),
        "\n\nInvoice Summary:\n- Total invoices: ", _s("total_invoices"),
        "\n- Total invoice value: $", money_text("total_amount"),
        "\n- Average invoice amount: $", money_text("avg_amount"),
        "\n- Paid invoices: ", _s("paid_count"), "\n- Overdue invoices: ", _s("overdue_count"),
        "\n- Disputed invoices: ", _s("disputed_count"),
        "\n\nRisk Analysis:\n- Overdue rate: ", money_text("overdue_rate"), "%\n- Dispute rate: ",
        money_text("dispute_rate"), "%\n- Risk score: ", money_text("risk_score"),
        "\n\nAssessment: ", F.when(F.col("risk_score") > high_risk, F.lit(VENDOR_HIGH)).otherwise(F.lit(VENDOR_LOW)))
    return vendors.select(F.concat(F.lit("vendor_"), _s("vendor_id")).alias("doc_id"),
                          F.lit("vendor_summary").alias("doc_type"), _s("vendor_id").alias("vendor_id"),
                          text.alias("text"))


def anomaly_documents(tiered: DataFrame, cap: int | None = None) -> DataFrame:
    """Alerts for all CRITICAL / HIGH rows. With ``cap`` only the most anomalous ones (ties by invoice_id;
    ``orderBy().limit()`` is a per-task top-n): a demo asks for 200.
    """
    flagged = tiered.where(F.col("risk_level").isin("CRITICAL", "HIGH"))
    if cap is not None:
        flagged = flagged.orderBy(F.col("anomaly_score").asc(), F.col("invoice_id").asc()).limit(cap)
    text = _lines(
        "Anomaly Alert: Invoice ", _s("invoice_id"), "\nRisk Level: ", _s("risk_level"),
        "\nVendor ID: ", _s("vendor_id"), "\nInvoice Amount: $", money_text("amount"),
        "\nAnomaly Score: ", py_float_text("anomaly_score"), "\nDays Overdue: ", _s("days_overdue"),
        "\n\nReason for flagging: This invoice was identified as anomalous by the \nIsolation Forest model. ",
        F.when(F.col("amount") == 0, F.lit(ANOMALY_ZERO)).otherwise(F.lit(ANOMALY_OTHER)),
        "\n\nRecommended action: ",
        F.when(F.col("risk_level") == "CRITICAL", F.lit(ACTION_CRITICAL)).otherwise(F.lit(ACTION_OTHER)))
    return flagged.select(F.concat(F.lit("anomaly_"), _s("invoice_id")).alias("doc_id"),
                          F.lit("anomaly_alert").alias("doc_type"), _s("invoice_id").alias("invoice_id"),
                          _s("risk_level").alias("risk_level"), text.alias("text"))


def trend_documents(trends: DataFrame, elevated: float = 15.0) -> DataFrame:
    """One report per month; the trend note depends on overdue_rate > ``elevated``."""
    text = _lines(
        "Monthly Invoice Report: ", _s("year_month"),
        "\n\nVolume:\n- Total invoices processed: ", _s("total_invoices"),
        "\n- Total invoice value: $", money_text("total_amount"),
        "\n- Average invoice amount: $", money_text("avg_amount"),
        "\n\nPayment Health:\n- Overdue invoices: ", _s("overdue_count"), " (", money_text("overdue_rate"),
        "% overdue rate)\n- Disputed invoices: ", _s("disputed_count"),
        "\n\nTrend note: ", F.when(F.col("overdue_rate") > elevated, F.lit(TREND_ELEVATED)).otherwise(F.lit(TREND_NORMAL)))
    return trends.select(F.concat(F.lit("trend_"), _s("year_month")).alias("doc_id"),
                         F.lit("monthly_trend").alias("doc_type"), _s("year_month").alias("year_month"),
                         text.alias("text"))


def document_union(*docs: DataFrame) -> DataFrame:
    """Documents of different kinds under one schema; absent metadata columns are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), docs)
    for c in DOC_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*DOC_COLUMNS, *[c for c in out.columns if c not in DOC_COLUMNS])


def chunk_count(length: Column, size: int, step: int) -> Column:
    """Windows start at 0, step, 2*step, ... and stop once a window reaches the end; empty text -> 0."""
    return (F.when(length <= 0, F.lit(0))
             .when(length <= size, F.lit(1))
             .otherwise(F.ceil((length - F.lit(size)) / F.lit(step)).cast("int") + 1))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP_CHARS) -> DataFrame:
    """Overlapping character windows of ``size`` with ``overlap``; ids ``<doc>_chunk_<i>``; metadata carried.

    Lengths and offsets count code points, like Python string slicing.
    """
    step = size - overlap
    n = chunk_count(F.length(text_col), size, step)
    idx = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    exploded = docs.select("*", idx.alias("chunk_idx"))
    return exploded.select(
        *[c for c in docs.columns if c != text_col],
        F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), F.col("chunk_idx").cast("string")).alias("chunk_id"),
        F.substring(F.col(text_col), F.col("chunk_idx") * step + 1, size).alias("chunk_text"),
        F.col("chunk_idx").cast("int").alias("chunk_idx"))
