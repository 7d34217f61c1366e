"""Operators over an anomaly-score column: percentile risk tiers, contamination threshold,
scoring report and most-anomalous lists. Work with any numeric score column, so they are
tested on a fixed score as well as on the forest's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.exprs import np_round, with_scalars
from quillspark.functions.quantiles import exact_percentiles
from quillspark.session import materialize

TIER_PROBS = (0.05, 0.10, 0.25)


def fixed_score(silver: DataFrame) -> DataFrame:
    """Deterministic stand-in score from the invoice number (FIXTURES contract), for SQL-checkable tests."""
    num = F.expr("CAST(substring(invoice_id, 5) AS BIGINT)")
    score = ((num * 7919) % 1000003 - 50000) / F.lit(1000003.0)
    return silver.select("invoice_id", "vendor_id", F.col("amount").cast("double").alias("amount"),
                         "days_overdue", score.alias("anomaly_score"))


def risk_tiers(scored: DataFrame, score: str = "anomaly_score", materialize_input: bool = True) -> DataFrame:
    """score <= p5 CRITICAL, <= p10 HIGH, <= p25 MEDIUM, else LOW (exact numpy percentiles).

    The percentiles read the scores in three passes and the tiers in a fourth, so the scored
    input is materialised once first (lineage cut) unless the caller already did.
    """
    if materialize_input:
        scored = materialize(scored)
    cuts = exact_percentiles(scored, score, TIER_PROBS, names=["__p5", "__p10", "__p25"])
    s = F.col(score)
    tier = (F.when(s <= F.col("__p5"), "CRITICAL").when(s <= F.col("__p10"), "HIGH")
             .when(s <= F.col("__p25"), "MEDIUM").otherwise("LOW"))
    return with_scalars(scored, cuts).withColumn("risk_level", tier).drop("__p5", "__p10", "__p25")


def contamination_cut(scored: DataFrame, contamination: float, score: str = "anomaly_score",
                      materialize_input: bool = True) -> DataFrame:
    """decision = score - percentile(score, contamination); anomaly when decision < 0."""
    if materialize_input:
        scored = materialize(scored)
    cut = exact_percentiles(scored, score, [contamination], names=["__cut"])
    return (with_scalars(scored, cut)
            .withColumn("decision", F.col(score) - F.col("__cut"))
            .withColumn("is_anomaly", F.col("decision") < 0).drop("__cut"))


def scoring_report(scored: DataFrame) -> DataFrame:
    """Totals of a scored table: rows, anomalies and their share (%, 1 decimal), critical and high counts."""
    n = F.count(F.lit(1))
    a = F.count_if("is_anomaly")
    return scored.agg(
        n.cast("bigint").alias("total_scored"), a.cast("bigint").alias("anomalies"),
        np_round(a / n * F.lit(100.0), 1).alias("anomaly_pct"),
        F.count_if(F.col("risk_level") == "CRITICAL").cast("bigint").alias("critical"),
        F.count_if(F.col("risk_level") == "HIGH").cast("bigint").alias("high"))


def top_anomalies(scored: DataFrame, n: int, score: str = "anomaly_score") -> DataFrame:
    """The n most anomalous flagged rows (lowest score, ties by invoice_id). The limit is the feature:
    ``orderBy().limit()`` plans a per-task top-n (TakeOrderedAndProject), not a global sort."""
    return (scored.where("is_anomaly").orderBy(F.col(score).asc(), F.col("invoice_id").asc()).limit(n)
            .select("invoice_id", "vendor_id", "amount", score,
                    F.when(F.col("is_anomaly"), "ANOMALY").otherwise("NORMAL").alias("anomaly_label")))
