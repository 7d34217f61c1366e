"""Lazy layer DataFrames over one input folder: raw -> bronze -> silver -> gold.

Nothing here runs a job; each accessor returns a plan that Catalyst optimises as a whole
(column pruning reaches the Parquet scans of orders/customer/nation).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import RunConfig
from quillspark.operators import bronze as bronze_ops
from quillspark.operators import gold as gold_ops
from quillspark.operators import silver as silver_ops
from quillspark.session import materialize
from quillspark.sources.fixtures import raw_invoices


@dataclass
class Layers:
    """``shared=True``: silver is materialised once (reliable checkpoint in spark.checkpoint.dir)
    for queries that read it several times (checks, several gold tables, documents, the forest);
    single-consumer queries stay fully lazy so Catalyst can prune and push down end to end."""

    spark: SparkSession
    sf_dir: str
    cfg: RunConfig = RunConfig()
    shared: bool = False
    _silver: DataFrame | None = None

    def raw(self) -> DataFrame:
        return raw_invoices(self.spark, self.sf_dir)

    def bronze(self) -> DataFrame:
        return bronze_ops.add_metadata(self.raw(), self.cfg.ingested_at)

    def silver(self) -> DataFrame:
        if not self.shared:
            return silver_ops.transform(self.bronze(), self.cfg)
        if self._silver is None:
            self._silver = materialize(silver_ops.transform(self.bronze(), self.cfg))
        return self._silver

    def vendor_summary(self) -> DataFrame:
        return gold_ops.vendor_summary(self.silver())

    def monthly_trends(self) -> DataFrame:
        return gold_ops.monthly_trends(self.silver())

    def category_analysis(self) -> DataFrame:
        return gold_ops.category_analysis(self.silver())


def silver_output(silver: DataFrame) -> DataFrame:
    """Silver as compared with the oracle: audit timestamps dropped, money as double, dates as ISO text."""
    return (silver.drop("_ingested_at", "_processed_at")
            .withColumn("amount", F.col("amount").cast("double"))
            .withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd"))
            .withColumn("due_date", F.date_format("due_date", "yyyy-MM-dd")))
