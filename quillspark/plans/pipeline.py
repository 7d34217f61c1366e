"""Pipeline compositions: batch medallion run, gated layered run, model run, retrieval run.

Each layer is written once and read back by its consumers (silver feeds three gold tables,
features and checks), so no consumer recomputes the upstream lineage and an executor loss
only repeats the current stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import MODEL_FEATURES, RunConfig
from quillspark.functions.exprs import with_scalars
from quillspark.operators import bronze as bronze_ops
from quillspark.operators import documents as doc_ops
from quillspark.operators import features as feat_ops
from quillspark.operators import gold as gold_ops
from quillspark.operators import iforest
from quillspark.operators import quality as qual_ops
from quillspark.operators import refresh
from quillspark.operators import risk as risk_ops
from quillspark.operators import silver as silver_ops
from quillspark.operators import vectors as vec_ops
from quillspark.session import materialize
from quillspark.sources import io
from quillspark.sources.fixtures import raw_invoices


@dataclass
class LakePaths:
    root: str

    def __getattr__(self, name: str) -> str:  # bronze, silver, vendor_summary, ...
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name}"


@dataclass
class BatchResult:
    paths: LakePaths
    counts: dict = field(default_factory=dict)


def run_batch(spark: SparkSession, raw: DataFrame, root: str, cfg: RunConfig = RunConfig()) -> BatchResult:
    """raw -> bronze -> silver (partitioned) -> vendor / month / category gold tables."""
    p = LakePaths(root)
    io.write_bronze(bronze_ops.add_metadata(raw, cfg.ingested_at), p.bronze)
    bronze = io.read_parquet_tree(spark, p.bronze)
    io.write_silver(silver_ops.transform(bronze, cfg), p.silver)
    silver = io.read_partitioned(spark, p.silver)
    io.write_gold(gold_ops.vendor_summary(silver), p.vendor_summary, cfg.ingested_at)
    io.write_gold(gold_ops.monthly_trends(silver), p.monthly_trends, cfg.ingested_at)
    io.write_gold(gold_ops.category_analysis(silver), p.category_analysis, cfg.ingested_at)
    return BatchResult(p)


def run_all(spark: SparkSession, raw: DataFrame, root: str, cfg: RunConfig = RunConfig(),
            enforce: bool = True) -> DataFrame:
    """Layer -> quality report -> gate -> next layer; returns the full quality report (also written as JSON)."""
    p = LakePaths(root)

    def gate(layer: str, report: DataFrame) -> None:
        """Each check runs once, into the report; the gate reads the written rows."""
        out = f"{p.quality_reports}/{layer}"
        io.write_json(report, out)
        if enforce:
            qual_ops.enforce(spark.read.json(out, schema=qual_ops.REPORT_SCHEMA))

    io.write_bronze(bronze_ops.add_metadata(raw, cfg.ingested_at), p.bronze)
    bronze = io.read_parquet_tree(spark, p.bronze)
    gate("bronze", qual_ops.bronze_report(spark, bronze, cfg))
    io.write_silver(silver_ops.transform(bronze, cfg), p.silver)
    silver = io.read_partitioned(spark, p.silver)
    gate("silver", qual_ops.silver_report(spark, silver, cfg))
    io.write_gold(gold_ops.vendor_summary(silver), p.vendor_summary, cfg.ingested_at)
    io.write_gold(gold_ops.monthly_trends(silver), p.monthly_trends, cfg.ingested_at)
    io.write_gold(gold_ops.category_analysis(silver), p.category_analysis, cfg.ingested_at)
    v, m, c = (spark.read.parquet(x) for x in (p.vendor_summary, p.monthly_trends, p.category_analysis))
    gate("gold", qual_ops.gold_report(spark, v, m, c, cfg))
    return spark.read.option("recursiveFileLookup", True).json(p.quality_reports, schema=qual_ops.REPORT_SCHEMA)


def run_ml(spark: SparkSession, root: str, categories: list[str] | None = None,
           runs: list[iforest.ForestParams] | None = None) -> DataFrame:
    """features -> forest sweep -> scores of the latest run with risk tiers; writes features, trees, runs, scores.
    ``categories``: their dense one-hot columns, by default those observed; an empty list for one sparse vector instead."""
    p = LakePaths(root)
    silver = io.read_partitioned(spark, p.silver)
    vendors = spark.read.parquet(p.vendor_summary)
    cats = feat_ops.observed_categories(silver) if categories is None else categories
    coded = feat_ops.sparse_onehot(silver, feat_ops.category_codes(silver)) if not cats else silver
    inv = feat_ops.invoice_features(coded, cats, keep=() if cats else ("category_vec",))
    feats = feat_ops.vendor_features(inv, vendors)
    io.write_table(feats.withColumn("row_id", F.monotonically_increasing_id()), p.features)   # invoice ids may repeat
    feats = spark.read.parquet(p.features)
    matrix, cols = feat_ops.model_matrix(feats, MODEL_FEATURES)
    io.write_table(feat_ops.scaler_moments(matrix, cols), p.scaler)        # stored with the model
    io.write_table(feat_ops.standard_scale(matrix, cols, spark.read.parquet(p.scaler)), p.scaled)
    scaled = spark.read.parquet(p.scaled)
    runs = runs or iforest.experiments()
    io.write_table(iforest.fit(scaled, cols, runs), p.trees)
    trees = spark.read.parquet(p.trees)
    io.write_table(iforest.score(scaled, cols, trees, ("row_id",)), p.raw_scores)
    decisions, offsets = iforest.decide(spark.read.parquet(p.raw_scores), runs)
    io.write_table(offsets, p.offsets)
    io.write_table(decisions, p.decisions)
    decisions = spark.read.parquet(p.decisions)
    io.write_table(iforest.run_metrics(decisions, runs, len(cols)), p.runs)
    best = iforest.latest(spark.read.parquet(p.runs)).select("run_id")
    chosen = decisions.join(F.broadcast(best), "run_id").drop("run_id")   # one-row side
    scored = risk_ops.risk_tiers(chosen.join(feats, "row_id").drop("row_id"))
    io.write_table(scored, p.scores)
    top = risk_ops.top_anomalies(spark.read.parquet(p.scores), 20)
    io.write_csv_report(top, p.top_anomalies)
    return spark.read.parquet(p.scores)


def run_scoring(spark: SparkSession, root: str, features: DataFrame | None = None,
                refit_scaler: bool = False) -> DataFrame:
    """Production scoring: resolve the latest run, scale with its stored moments (or refit on the
    new data), score with its trees, apply its stored contamination offset, add risk tiers."""
    p = LakePaths(root)
    feats = features if features is not None else spark.read.parquet(p.features)
    if "row_id" not in feats.columns:  # invoice ids may repeat: rows are joined back by a number of their own
        feats = materialize(feats.withColumn("row_id", F.monotonically_increasing_id()))
    runs = spark.read.parquet(p.runs)
    best = iforest.latest(runs).select("run_id", "contamination").first()
    matrix, cols = feat_ops.model_matrix(feats, MODEL_FEATURES)
    moments = None if refit_scaler else spark.read.parquet(p.scaler)
    scaled = feat_ops.standard_scale(matrix, cols, moments)
    trees = spark.read.parquet(p.trees).where(F.col("run_id") == best.run_id)
    raw = iforest.score(scaled, cols, trees, ("row_id",))
    offset = spark.read.parquet(p.offsets).where(F.col("run_id") == best.run_id).select("offset")
    decided = (with_scalars(raw.drop("run_id"), offset)
               .withColumn("anomaly_score", F.col("score") - F.col("offset"))
               .withColumn("is_anomaly", F.col("anomaly_score") < 0).drop("score", "offset"))
    return risk_ops.risk_tiers(decided.join(feats, "row_id").drop("row_id"))


def run_retrieval(spark: SparkSession, root: str, questions: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """gold + scores -> documents -> chunks (JSON) -> vectors -> filtered top-k -> prompt context (JSON)."""
    p = LakePaths(root)
    docs = doc_ops.document_union(
        doc_ops.vendor_documents(spark.read.parquet(p.vendor_summary), cfg.high_risk_score),
        doc_ops.anomaly_documents(spark.read.parquet(p.scores), cfg.anomaly_doc_cap),
        doc_ops.trend_documents(spark.read.parquet(p.monthly_trends), cfg.elevated_overdue_rate))
    io.write_json(doc_ops.chunk_documents(docs).drop("text"), p.chunks)
    chunks = io.read_chunks_json(spark, p.chunks)
    rows = chunks.withColumn("row_id", vec_ops.row_key("chunk_id"))   # chunk ids may repeat
    refresh.refresh(rows, "chunk_text", p.vectors, lambda t: vec_ops.hashed_bow(t, refresh.HASH, "chunk_text"))
    index = refresh.read(spark, p.vectors)
    qvec = (vec_ops.hashed_bow(questions, "query_id", "question", keep=["doc_type"])
            .withColumnRenamed("embedding", "query_vec"))
    hits = vec_ops.knn_topk(index, qvec, corpus_id="row_id", corpus_filter="doc_type", query_filter="doc_type")
    hits = hits.join(index.select("row_id", "chunk_id", "doc_type", "chunk_text"), "row_id")
    answers = vec_ops.prompt_context(questions, hits, text_col="chunk_text").join(questions, "query_id")
    io.write_json(answers, p.answers)
    return spark.read.json(p.answers)


def batch_from_tables(spark: SparkSession, sf_dir: str, root: str, cfg: RunConfig = RunConfig()) -> BatchResult:
    return run_batch(spark, raw_invoices(spark, sf_dir), root, cfg)
