"""Feature table for the anomaly model: invoice-level features plus vendor-level features joined on vendor_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import MODEL_FEATURES, VALID_STATUSES
from quillspark.functions.exprs import ref, with_scalars
from quillspark.functions.moments import exact_moments
from quillspark.session import materialize

ZSCORE_EPS = 1e-9


def observed_categories(silver: DataFrame, max_values: int = 1000) -> list[str]:
    """Distinct categories, sorted (the one-hot column set depends on the data, like ``get_dummies``).

    Only the distinct values reach the driver, and their number is checked: a column each is no form for very many.
    ``category_codes`` and ``sparse_onehot`` take any number.
    """
    vals = [r[0] for r in silver.select("category").distinct().where(F.col("category").isNotNull())
            .limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"more than {max_values} categories; pass an explicit list, or use sparse_onehot")
    return sorted(vals)


def category_codes(df: DataFrame, column: str = "category") -> DataFrame:
    """Dictionary (``column``, code): its distinct non-null values numbered from 0 in ascending order, for any number of values.

    Values are dealt by ranges and sorted within each; a range starts where the counts of those before it end, so no task
    holds more than one range. Only one number per range is summed up over all of them.
    """
    values = df.select(column).where(F.col(ref(column)).isNotNull()).distinct()
    # the written ranges are read twice: sampled bounds must not be drawn anew
    ranges = materialize(values.repartitionByRange(F.col(ref(column))).sortWithinPartitions(F.col(ref(column)))
                         .withColumn("__place", F.monotonically_increasing_id()))
    ranges = ranges.selectExpr(ref(column), "shiftright(__place, 33) AS __range", "__place & 8589934591L AS __within")
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    return ranges.join(F.broadcast(starts), "__range").select(F.col(ref(column)), (F.col("__start") + F.col("__within")).alias("code"))


def sparse_onehot(df: DataFrame, codes: DataFrame, column: str = "category", out: str = "category_vec") -> DataFrame:
    """``df`` with a sparse one-hot vector of ``column``: struct(size, indices, values), as wide as the dictionary has entries.

    A null or unknown value is the empty vector. The dictionary may have any number of entries: Spark broadcasts it while its
    measured size is small, and otherwise sorts, where AQE splits a hot value on the side of the rows.
    """
    width = codes.agg(F.count(F.lit(1)).alias("__width"))
    known = codes.select(F.col(ref(column)).alias("__value"), F.col("code").alias("__code"))
    hit = F.col("__code").isNotNull()
    vector = F.struct(F.col("__width").alias("size"),
                      F.when(hit, F.array("__code")).otherwise(F.array().cast("array<bigint>")).alias("indices"),
                      F.when(hit, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
    joined = df.join(known, F.col(ref(column)) == F.col("__value"), "left")
    return with_scalars(joined, width).withColumn(out, vector).drop("__value", "__code", "__width")


def invoice_features(silver: DataFrame, categories: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Amount, z-score (sample std), log1p, round-amount flag, calendar, status and category one-hots.

    The global mean / std are one row, the same to the last bit for any partitioning, attached as a scalar.
    ``keep`` names further columns to pass through.
    """
    amount = F.col("amount").cast("double")
    df = with_scalars(silver, exact_moments(silver, ["amount"], ddof=1, mean="__mean", std="__std"))
    d = F.col("invoice_date")
    dow = F.coalesce(F.weekday(d), F.lit(0))          # Monday = 0
    cols = [
        F.col("invoice_id"), F.col("vendor_id"),
        F.coalesce(amount, F.lit(0.0)).alias("amount"),
        F.coalesce((amount - F.col("__mean")) / (F.col("__std") + F.lit(ZSCORE_EPS)), F.lit(0.0)).alias("amount_zscore"),
        F.log1p(F.coalesce(amount, F.lit(0.0))).alias("amount_log"),
        F.coalesce(F.col("amount") % 1000 == 0, F.lit(False)).cast("int").alias("is_round_amount"),
        F.coalesce(F.col("days_overdue"), F.lit(0)).cast("int").alias("days_overdue"),
        F.coalesce(F.month(d), F.lit(0)).alias("invoice_month"),
        dow.alias("invoice_dow"),
        (dow >= 5).cast("int").alias("is_weekend"),
        F.coalesce(F.quarter(d), F.lit(0)).alias("invoice_quarter"),
    ]
    cols += [F.coalesce(F.col("status") == s, F.lit(False)).cast("int").alias(f"status_{s}") for s in VALID_STATUSES]
    cols += [F.coalesce(F.col("category") == c, F.lit(False)).cast("int").alias(f"cat_{c}") for c in categories]
    return df.select(*cols, *[F.col(ref(c)) for c in keep])


def vendor_features(inv: DataFrame, vendors: DataFrame) -> DataFrame:
    """LEFT join of vendor metrics on vendor_id and the amount-to-vendor-average ratio (null -> 1.0).

    The vendor table grows with the data, so no broadcast is forced: Spark broadcasts it only
    when its measured size is under the threshold, else sort-merge joins, and AQE splits a
    skewed (hot) vendor partition on the invoice side.
    """
    v = vendors.select(
        "vendor_id",
        F.col("total_invoices").cast("double").alias("vendor_total_invoices"),
        F.col("avg_amount").alias("vendor_avg_amount"),
        F.col("overdue_rate").alias("vendor_overdue_rate"),
        F.col("dispute_rate").alias("vendor_dispute_rate"),
        F.col("risk_score").alias("vendor_risk_score"),
        F.col("total_amount").alias("vendor_total_amount"))
    out = inv.join(v, "vendor_id", "left")
    ratio = F.coalesce(F.try_divide(F.col("amount"), F.col("vendor_avg_amount") + F.lit(ZSCORE_EPS)), F.lit(1.0))
    return out.withColumn("amount_vs_vendor_avg", ratio).select(*inv.columns, *v.columns[1:], "amount_vs_vendor_avg")


def model_matrix(features: DataFrame, cols: Sequence[str] = MODEL_FEATURES) -> tuple[DataFrame, list[str]]:
    """Keep the listed feature columns that exist, nulls as 0 (ids kept alongside)."""
    avail = [c for c in cols if c in features.columns]
    ids = [c for c in ("row_id", "invoice_id", "vendor_id") if c in features.columns]
    return features.select(*ids, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in avail]), avail


def scaler_moments(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-feature mean and population std (StandardScaler semantics; zero std -> 1), equal bits for any partitioning.
    Reads ``matrix`` three times: pass a written one."""
    return exact_moments(matrix, cols)


def standard_scale(matrix: DataFrame, cols: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std_pop per column. ``moments`` may be stored ones (scoring) or refit here (default)."""
    moments = moments if moments is not None else scaler_moments(matrix, cols)
    j = with_scalars(matrix, moments)
    keep = [c for c in matrix.columns if c not in cols]
    scaled = [((F.col(c) - F.col(f"__mu_{c}")) /
               F.when(F.col(f"__sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__sd_{c}"))).alias(c) for c in cols]
    return j.select(*keep, *scaled)


def feature_profile(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).cast("bigint").alias("records"),
        F.lit(len(features.columns)).cast("bigint").alias("features"),
        (F.rint(F.avg("amount_zscore") * F.lit(1e4)) / F.lit(1e4) + F.lit(0.0)).alias("avg_amount_zscore"),
        F.sum("is_round_amount").cast("bigint").alias("round_amounts"),
    )
