"""Query keys of the operator families beyond the medallion layers (quality, features, scoring,
documents, retrieval, streaming, forest). Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.config import MODEL_FEATURES
from quillspark.functions.exprs import np_round
from quillspark.functions.moments import exact_moments
from quillspark.functions.quantiles import exact_percentiles
from quillspark.operators import features as feat_ops
from quillspark.operators import gold as gold_ops
from quillspark.operators import quality as qual_ops
from quillspark.operators import risk as risk_ops
from quillspark.plans.catalog import L, query
from quillspark.session import materialize
from quillspark.sources.tables import read_table

# Category one-hot columns of the driver data (customer market segments, title-cased).
FIXTURE_CATEGORIES = ("Automobile", "Building", "Furniture", "Household", "Machinery")


# --- quality -------------------------------------------------------------------------------
@query("quality_bronze")
def q_quality_bronze(spark, sf_dir):
    lay = L(spark, sf_dir)
    return qual_ops.bronze_report(spark, lay.bronze(), lay.cfg)


@query("quality_silver")
def q_quality_silver(spark, sf_dir):
    lay = L(spark, sf_dir)
    return qual_ops.silver_report(spark, lay.silver(), lay.cfg)


@query("quality_gold")
def q_quality_gold(spark, sf_dir):
    lay = L(spark, sf_dir, shared=True)
    return qual_ops.gold_report(spark, lay.vendor_summary(), lay.monthly_trends(), lay.category_analysis(), lay.cfg)


@query("quality_summary")
def q_quality_summary(spark, sf_dir):
    lay = L(spark, sf_dir, shared=True)
    report = (qual_ops.bronze_report(spark, lay.bronze(), lay.cfg)
              .unionByName(qual_ops.silver_report(spark, lay.silver(), lay.cfg))
              .unionByName(qual_ops.gold_report(spark, lay.vendor_summary(), lay.monthly_trends(),
                                                lay.category_analysis(), lay.cfg)))
    return qual_ops.summary(report)


# --- features ------------------------------------------------------------------------------
def _features(spark, sf_dir, lay=None):
    lay = lay or L(spark, sf_dir, shared=True)
    silver = lay.silver()
    inv = feat_ops.invoice_features(silver, FIXTURE_CATEGORIES)
    return feat_ops.vendor_features(inv, gold_ops.vendor_summary(silver))


@query("invoice_features")
def q_invoice_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query("feature_profile")
def q_feature_profile(spark, sf_dir):
    return feat_ops.feature_profile(_features(spark, sf_dir))


@query("standard_scaler")
def q_standard_scaler(spark, sf_dir):
    matrix, cols = feat_ops.model_matrix(_features(spark, sf_dir), MODEL_FEATURES)
    # engines add doubles in different orders: four decimals are the same in all
    scaled = feat_ops.standard_scale(matrix, cols)
    return scaled.select(*[(np_round(c, 4) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in scaled.columns])


@query("column_moments")
def q_column_moments(spark, sf_dir):
    """Mean and population deviation of the measures of all line items, the same to the last bit for any partitioning."""
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    row = exact_moments(read_table(spark, sf_dir, "lineitem"), cols, mean="mean_{}", std="std_{}")
    return row.select(*[np_round(c, 6).alias(c) for c in row.columns])


@query("category_codes")
def q_category_codes(spark, sf_dir):
    """Dictionary of the vendors' names: as many categories as the data have vendors."""
    return feat_ops.category_codes(L(spark, sf_dir).silver(), "vendor_name")


@query("category_sparse")
def q_category_sparse(spark, sf_dir):
    """Sparse one-hot vectors of the vendors' names of all invoices, by their parts."""
    silver = L(spark, sf_dir, shared=True).silver()
    vec = feat_ops.sparse_onehot(silver, feat_ops.category_codes(silver, "vendor_name"), "vendor_name", "vec")
    return vec.select("invoice_id", "vendor_name", F.col("vec.size").alias("width"), F.get("vec.indices", F.lit(0)).alias("code"),
                      F.aggregate("vec.values", F.lit(0.0), lambda a, x: a + x).alias("ones"))


# --- scores, tiers, percentiles --------------------------------------------------------------
def _fixed_scored(spark, sf_dir, lay=None):
    return risk_ops.fixed_score((lay or L(spark, sf_dir)).silver())


def _fixed_tiered(spark, sf_dir, lay=None):
    scored = _fixed_scored(spark, sf_dir, lay).withColumn("is_anomaly", F.col("anomaly_score") < 0)
    # over an already materialised silver the score is a cheap projection: no second lineage cut
    return risk_ops.risk_tiers(scored, materialize_input=not (lay is not None and lay.shared))


@query("score_percentiles")
def q_score_percentiles(spark, sf_dir):
    """p5 / p10 / p25 of events.value (exact, numpy interpolation)."""
    ev = read_table(spark, sf_dir, "events")
    return exact_percentiles(ev, "value", risk_ops.TIER_PROBS, names=["p5", "p10", "p25"])


@query("risk_tiers")
def q_risk_tiers(spark, sf_dir):
    return _fixed_tiered(spark, sf_dir)


@query("event_value_tiers")
def q_event_value_tiers(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", F.col("value").alias("anomaly_score"))
    return risk_ops.risk_tiers(ev)


@query("contamination_cut")
def q_contamination_cut(spark, sf_dir):
    return risk_ops.contamination_cut(_fixed_scored(spark, sf_dir), 0.05)


@query("scoring_report")
def q_scoring_report(spark, sf_dir):
    return risk_ops.scoring_report(_fixed_tiered(spark, sf_dir))


@query("top_anomalies")
def q_top_anomalies(spark, sf_dir):
    # no tier in the list: the flag and the order need the score alone
    return risk_ops.top_anomalies(_fixed_scored(spark, sf_dir).withColumn("is_anomaly", F.col("anomaly_score") < 0), 20)


@query("top_anomalies_report")
def q_top_anomalies_report(spark, sf_dir):
    t = _fixed_tiered(spark, sf_dir)
    return (t.where("is_anomaly").orderBy(F.col("anomaly_score"), F.col("invoice_id")).limit(10)
            .select("invoice_id", "vendor_id", "amount", "anomaly_score", "risk_level"))


# --- the demo questions as structured queries ----------------------------------------------------
@query("q_highest_overdue_vendors")
def q_highest_overdue(spark, sf_dir):
    v = L(spark, sf_dir).vendor_summary()
    return (v.orderBy(F.col("overdue_rate").desc(), "vendor_id", "vendor_name", "state").limit(5)
            .select("vendor_id", "vendor_name", "state", "overdue_rate", "overdue_count", "total_invoices"))


@query("q_critical_invoices")
def q_critical(spark, sf_dir):
    return _fixed_tiered(spark, sf_dir).where(F.col("risk_level") == "CRITICAL")


TREND_YEAR = "1998"


@query("q_trends_year")
def q_trends_year(spark, sf_dir):
    return L(spark, sf_dir).monthly_trends().where(F.col("year_month").startswith(TREND_YEAR + "-"))


@query("q_dispute_vendors")
def q_dispute_vendors(spark, sf_dir):
    v = L(spark, sf_dir).vendor_summary()
    return (v.where(F.col("disputed_count") > 0)
            .select("vendor_id", "vendor_name", "state", "disputed_count", "dispute_rate", "total_invoices"))


@query("q_zero_amount_invoices")
def q_zero_amount(spark, sf_dir):
    s = L(spark, sf_dir).silver()
    return s.where(F.col("amount") == 0).select("invoice_id", "vendor_id", F.col("amount").cast("double").alias("amount"),
                                               "status", "_amount_was_null")




# --- documents and chunks ------------------------------------------------------------------
from quillspark.operators import documents as doc_ops  # noqa: E402
from quillspark.operators import vectors as vec_ops  # noqa: E402


def _gold_docs(spark, sf_dir):
    lay = L(spark, sf_dir, shared=True)
    return doc_ops.document_union(
        doc_ops.vendor_documents(lay.vendor_summary(), lay.cfg.high_risk_score),
        doc_ops.anomaly_documents(_fixed_tiered(spark, sf_dir, lay), lay.cfg.anomaly_doc_cap),
        doc_ops.trend_documents(lay.monthly_trends(), lay.cfg.elevated_overdue_rate))


@query("vendor_documents")
def q_vendor_documents(spark, sf_dir):
    return doc_ops.vendor_documents(L(spark, sf_dir).vendor_summary())


@query("anomaly_documents")
def q_anomaly_documents(spark, sf_dir):
    return doc_ops.anomaly_documents(_fixed_tiered(spark, sf_dir))


@query("trend_documents")
def q_trend_documents(spark, sf_dir):
    return doc_ops.trend_documents(L(spark, sf_dir).monthly_trends())


@query("document_union")
def q_document_union(spark, sf_dir):
    return _gold_docs(spark, sf_dir)


@query("document_chunks")
def q_document_chunks(spark, sf_dir):
    return doc_ops.chunk_documents(_gold_docs(spark, sf_dir)).drop("text")


def _text_chunks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return doc_ops.chunk_documents(docs)


@query("chunk_documents")
def q_chunk_documents(spark, sf_dir):
    return _text_chunks(spark, sf_dir)


# --- vectors and retrieval -------------------------------------------------------------------
@query("embed_chunks")
def q_embed_chunks(spark, sf_dir):
    return vec_ops.hashed_bow(_text_chunks(spark, sf_dir), "chunk_id", "chunk_text")


def label_centroids(emb):
    """One query per label: the element-wise mean embedding of that label (a distributed aggregation)."""
    per_pos = (emb.select("label", F.posexplode("embedding").alias("pos", "x"))
               .groupBy("label", "pos").agg(F.avg("x").alias("v")))
    return (per_pos.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pv"))
            .select(F.col("label").alias("query_id"), F.transform("pv", lambda s: s["v"]).alias("query_vec"),
                    F.col("label").alias("query_label")))


@query("knn_topk")
def q_knn_topk(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return vec_ops.knn_topk(emb, label_centroids(emb), corpus_id="vec_id")


@query("knn_filtered")
def q_knn_filtered(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return vec_ops.knn_topk(emb, label_centroids(emb), corpus_id="vec_id", corpus_filter="label",
                            query_filter="query_label")


@query("ann_topk")
def q_ann_topk(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return vec_ops.ann_topk(emb, label_centroids(emb), corpus_id="vec_id")


def _own_queries(emb):
    """Every tenth vector of the table as a query, restricted to its own label where its id is even."""
    return emb.where("vec_id % 10 = 0").selectExpr("vec_id query_id", "embedding query_vec", "if(vec_id % 20 = 0, label, null) query_label")


@query("knn_cells")
def q_knn_cells(spark, sf_dir):
    """Exact filtered top-k through the cells of an index, as it runs when queries are too many to ship."""
    emb = read_table(spark, sf_dir, "embeddings")
    return vec_ops.knn_topk(emb, _own_queries(emb), corpus_id="vec_id", corpus_filter="label", query_filter="query_label", few=0)


@query("ann_recall")
def q_ann_recall(spark, sf_dir):
    """The approximate search held against the exact one, over every tenth vector: queries, answers, and whether the recall is 0.95."""
    emb = read_table(spark, sf_dir, "embeddings")
    queries = _own_queries(emb)
    exact = vec_ops.knn_topk(emb, queries, corpus_id="vec_id").select("query_id", "vec_id")
    approx = vec_ops.ann_topk(emb, queries, corpus_id="vec_id").select("query_id", "vec_id", F.lit(1).alias("found"))
    both = exact.join(approx, ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("answers"),
                    (F.count("found") >= 0.95 * F.count("*")).alias("recall_ok"))


# The demo questions of the retrieval chain and their metadata filters (fixed values).
DEMO_QUESTIONS = (
    (1, "Which vendors have the highest overdue rates?", "vendor_summary"),
    (2, "What invoices are flagged as critical risk?", "anomaly_alert"),
    (3, "What were the invoice trends in 2024?", "monthly_trend"),
    (4, "Show me vendors with dispute problems", None),
    (5, "Which invoices have zero dollar amounts?", "anomaly_alert"),
)


def _question_hits(spark, sf_dir):
    # the chunk table feeds the index and the text lookup: materialised once
    chunks = doc_ops.chunk_documents(_gold_docs(spark, sf_dir)).select("chunk_id", "doc_type", "chunk_text")
    chunks = materialize(chunks.withColumn("row_id", vec_ops.row_key("chunk_id")))  # chunk ids may repeat
    index = vec_ops.hashed_bow(chunks, "row_id", "chunk_text", keep=["doc_type"])
    qs = spark.createDataFrame(list(DEMO_QUESTIONS), "query_id int, question string, doc_type string")
    qvec = vec_ops.hashed_bow(qs, "query_id", "question", keep=["doc_type"]).withColumnRenamed("embedding", "query_vec")
    hits = vec_ops.knn_topk(index, qvec, corpus_id="row_id", corpus_filter="doc_type", query_filter="doc_type")
    return qs, hits.join(chunks, "row_id")


@query("rag_retrieval")
def q_rag_retrieval(spark, sf_dir):
    _, hits = _question_hits(spark, sf_dir)
    return hits.select("query_id", "chunk_id", "doc_type", "similarity", "rank")


@query("prompt_context")
def q_prompt_context(spark, sf_dir):
    qs, hits = _question_hits(spark, sf_dir)
    return vec_ops.prompt_context(qs, hits, text_col="chunk_text").join(qs.select("query_id", "question"), "query_id")


# --- isolation forest ------------------------------------------------------------------------
from quillspark.config import MODEL_FEATURES as _MF  # noqa: E402
from quillspark.operators import iforest  # noqa: E402


def forest_run(spark, sf_dir, runs, lay=None):
    """features -> matrix, scaled matrix, trees and scores (each materialised once) -> decisions."""
    feats = _features(spark, sf_dir, lay)
    matrix, cols = feat_ops.model_matrix(feats, _MF)
    # the unscaled amount rides along: invoice ids may repeat, so nothing is joined back by them
    matrix = materialize(matrix.withColumn("raw_amount", F.col("amount")))  # the moments and the scaling both read it
    scaled = materialize(feat_ops.standard_scale(matrix, cols))
    trees = materialize(iforest.fit(scaled, cols, runs))
    scores = materialize(iforest.score(scaled, cols, trees, id_cols=("invoice_id", "vendor_id", "raw_amount")))
    decisions, offsets = iforest.decide(scores, runs)
    return scaled, cols, trees, decisions, offsets


@query("forest_scores")
def q_forest_scores(spark, sf_dir):
    runs = iforest.experiments()[:1]
    lay = L(spark, sf_dir, shared=True)
    _, _, _, decisions, _ = forest_run(spark, sf_dir, runs, lay)
    return risk_ops.risk_tiers(decisions.drop("run_id")).withColumnRenamed("raw_amount", "amount")


@query("forest_runs")
def q_forest_runs(spark, sf_dir):
    runs = iforest.experiments()
    _, cols, _, decisions, _ = forest_run(spark, sf_dir, runs)
    return iforest.run_metrics(decisions, runs, len(cols))


# --- streaming ingest --------------------------------------------------------------------------
from quillspark.functions.exprs import nan_to_null  # noqa: E402
from quillspark.session import scratch_path  # noqa: E402
from quillspark.streaming import ingest  # noqa: E402


@query("event_envelope")
def q_event_envelope(spark, sf_dir):
    """Keyed publish projection; fields read back from the JSON value."""
    lay = L(spark, sf_dir)
    env = ingest.envelope(lay.raw(), lay.cfg.ingested_at)
    m = F.from_json("value", ingest.MESSAGE_SCHEMA, {"allowNonNumericNumbers": "true"})
    return env.select("key", m.alias("m")).select(
        "key", "m.event_type", "m.event_timestamp", "m.source_system",
        F.col("m.payload.invoice_id").alias("invoice_id"), nan_to_null("m.payload.amount").alias("amount"))


@query("event_unwrap")
def q_event_unwrap(spark, sf_dir):
    """Mixed feed: even invoice numbers arrive in an envelope, odd ones as a bare payload; both unwrap alike."""
    lay = L(spark, sf_dir)
    raw = lay.raw()
    even = F.substring("invoice_id", -1, 1).cast("int") % 2 == 0
    mixed = raw.select(F.when(even, ingest.envelope_text(lay.cfg.ingested_at))
                       .otherwise(F.to_json(F.struct(*[F.col(c) for c in raw.columns]))).alias("value"))
    return ingest.unwrap(mixed).withColumn("amount", nan_to_null("amount"))


def _stream_run(spark, sf_dir):
    lay = L(spark, sf_dir)
    topic = scratch_path(spark, "topic")
    parts = ingest.publish_files(lay.raw(), topic, lay.cfg.ingested_at, files=8)
    out, ckpt = scratch_path(spark, "stream-bronze"), scratch_path(spark, "stream-ckpt")
    res = ingest.run_stream_bronze(ingest.file_source(spark, topic, max_files=parts), out, ckpt, lay.cfg.ingested_at)
    return res


@query("stream_bronze")
def q_stream_bronze(spark, sf_dir):
    res = _stream_run(spark, sf_dir)
    return spark.read.parquet(res.output).drop("_ingested_at")


@query("stream_progress")
def q_stream_progress(spark, sf_dir):
    return ingest.progress_frame(spark, _stream_run(spark, sf_dir))


# --- storage round trips ---------------------------------------------------------------------
from quillspark.operators import refresh  # noqa: E402
from quillspark.plans import pipeline  # noqa: E402


@query("silver_partition_prune")
def q_silver_partition_prune(spark, sf_dir):
    """Silver written hive-partitioned, read back with a filter on the partition columns
    (the scan lists only the matching directories: PartitionFilters in the plan)."""
    res = pipeline.batch_from_tables(spark, sf_dir, scratch_path(spark, "lake"))
    silver = spark.read.parquet(res.paths.silver)
    part = silver.where((F.col("invoice_year") == 1998) & (F.col("payment_quarter") == "Q2"))
    return gold_ops.status_breakdown(part)


@query("vector_refresh")
def q_vector_refresh(spark, sf_dir):
    """The chunks of all documents indexed, then again after every hundredth document changed and every 97th went: vectors made
    by each refresh, rows of the second snapshot, and how many of them have the vector that a full rebuild gives."""
    embed = lambda t: vec_ops.hashed_bow(t, refresh.HASH, "chunk_text")
    docs, root = read_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "vectors")
    first = refresh.refresh(doc_ops.chunk_documents(docs).select("chunk_id", "chunk_text"), "chunk_text", root, embed)
    changed = docs.where("doc_id % 97 <> 0").withColumn("text", F.expr("if(doc_id % 100 = 0, concat(doc_id, ' changed ', text), text)"))
    chunks = doc_ops.chunk_documents(changed).select("chunk_id", "chunk_text")
    second = refresh.refresh(chunks, "chunk_text", root, embed)
    rebuilt = vec_ops.hashed_bow(chunks, "chunk_id", "chunk_text").withColumnRenamed("embedding", "again")
    # counted, not filtered: a filter on the rebuilt vector is also put below the join, where it makes every vector twice
    both = refresh.read(spark, root).select("chunk_id", "embedding").join(rebuilt, "chunk_id")
    return both.agg(F.count_if(F.expr("embedding = again")).alias("same_as_rebuilt")).select(
        F.lit(first.embedded).alias("first_embedded"), F.lit(second.embedded).alias("second_embedded"),
        F.lit(second.rows).alias("second_rows"), "same_as_rebuilt")


@query("run_all_summary")
def q_run_all_summary(spark, sf_dir):
    """The gated run from raw files to gold, every report written and read back; the gate itself is off."""
    report = pipeline.run_all(spark, L(spark, sf_dir).raw(), scratch_path(spark, "gated"), L(spark, sf_dir).cfg, enforce=False)
    return qual_ops.summary(report)


@query("stream_restart")
def q_stream_restart(spark, sf_dir):
    """A limited publish is drained, more messages arrive, and the stream goes on from its checkpoint; a third run finds nothing."""
    lay = L(spark, sf_dir)
    topic, out, ckpt = (scratch_path(spark, n) for n in ("topic", "stream-bronze", "stream-ckpt"))
    rows = []
    for folder, limit in (("a", 100), ("b", None), (None, None)):
        if folder:
            parts = ingest.publish_files(lay.raw(), f"{topic}/{folder}", lay.cfg.ingested_at, files=3, max_messages=limit)
        res = ingest.run_stream_bronze(ingest.file_source(spark, f"{topic}/*", max_files=parts), out, ckpt, lay.cfg.ingested_at)
        rows.append((len(rows) + 1, res.rows_read))
    runs = spark.createDataFrame(rows, "run int, messages_read long")
    total = spark.read.parquet(out).agg(F.lit(0).alias("run"), F.count("*").alias("messages_read"))
    return runs.unionByName(total)


# --- text-typed storage, unions, ordering --------------------------------------------------------
from quillspark.operators import typing as typing_ops  # noqa: E402
from quillspark.plans.layers import silver_output  # noqa: E402

SILVER_TYPES = {"amount": "double", "invoice_date": "date", "due_date": "date", "_amount_was_null": "boolean",
                "days_to_due": "int", "days_overdue": "int", "is_overdue": "boolean", "invoice_year": "int"}


@query("restore_types")
def q_restore_types(spark, sf_dir):
    """Silver stored as text (every column a string) and re-typed on read: equals typed silver."""
    text = typing_ops.stringify(silver_output(L(spark, sf_dir).silver()).withColumn(
        "invoice_date", F.to_date("invoice_date")).withColumn("due_date", F.to_date("due_date")))
    back = typing_ops.restore_types(text, SILVER_TYPES)
    return (back.withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd"))
            .withColumn("due_date", F.date_format("due_date", "yyyy-MM-dd")))


@query("bronze_union")
def q_bronze_union(spark, sf_dir):
    """Batch bronze and stream-path bronze under one schema (the stream projection run on the message table)."""
    lay = L(spark, sf_dir)
    stream = ingest.stream_bronze_frame(ingest.envelope(lay.raw(), lay.cfg.ingested_at), lay.cfg.ingested_at)
    return lay.bronze().unionByName(stream).drop("_ingested_at")


@query("vendors_by_total")
def q_vendors_by_total(spark, sf_dir):
    return gold_ops.order_by_total(L(spark, sf_dir).vendor_summary(), "vendor_id", "vendor_name", "state")


# --- inputs that reach rare branches ---------------------------------------------------------------
from quillspark.operators import silver as silver_ops  # noqa: E402
from quillspark.sources import io  # noqa: E402


@query("amount_repair")
def q_amount_repair(spark, sf_dir):
    """Amount repair over discounts: values with ties at the third decimal, negative, missing and very large ones."""
    li = read_table(spark, sf_dir, "lineitem")
    amount = F.expr("CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN -l_extendedprice * l_discount "
                    "WHEN l_orderkey % 11 = 0 THEN l_extendedprice * 1e12D ELSE l_extendedprice * l_discount END")
    fixed = silver_ops.fix_amounts(li.select("l_orderkey", "l_linenumber", amount.cast("double").alias("amount")))
    return fixed.withColumn("amount", F.col("amount").cast("double"))


@query("csv_scan")
def q_csv_scan(spark, sf_dir):
    """Raw invoices through a CSV with doubled quotes, line ends in quotes and NA spellings, read back."""
    raw = L(spark, sf_dir).raw()
    out = scratch_path(spark, "csv")
    odd = F.expr("CASE WHEN notes IS NULL THEN 'N/A' ELSE concat('He said \"', notes, '\",\\n', state) END")
    (raw.withColumn("notes", odd).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\"")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out))
    return io.read_raw_csv(spark, out)


@query("parquet_tree")
def q_parquet_tree(spark, sf_dir):
    """Raw invoices in folders of different depth, read back as one table."""
    raw, out = L(spark, sf_dir).raw(), scratch_path(spark, "tree")
    for i, folder in enumerate(("a", "b/c")):
        raw.where(F.length("vendor_name") % 2 == i).write.mode("overwrite").parquet(f"{out}/{folder}")
    return io.read_parquet_tree(spark, out)


@query("chunks_json")
def q_chunks_json(spark, sf_dir):
    """Chunks of the documents table through JSON lines."""
    out = scratch_path(spark, "chunks")
    io.write_json(_text_chunks(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")), out)
    return io.read_chunks_json(spark, out).select("doc_id", "chunk_id", "chunk_text", "chunk_idx")


# Columns of silver that the features and the vendor summary take.
SCORED_COLUMNS = ("invoice_id", "vendor_id", "vendor_name", "state", "invoice_date", "amount", "status", "category", "days_overdue")


def _sent_again(silver):
    """Silver with first-quarter invoices once more, their amount raised by 1: one pass over silver."""
    copies = F.explode(F.when(F.col("payment_quarter") == "Q1", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return silver.withColumn("__more", copies).withColumn("amount", F.expr("CAST(amount + __more AS DECIMAL(28,2))")).drop("__more")


@query("scoring_rows")
def q_scoring_rows(spark, sf_dir):
    """Rows and amounts before and after scoring, with first-quarter invoices sent again under their ids with another amount."""
    both = materialize(_sent_again(L(spark, sf_dir).silver()).select(*SCORED_COLUMNS))  # the moments, the vendors and the features read it
    feats = materialize(feat_ops.vendor_features(feat_ops.invoice_features(both, FIXTURE_CATEGORIES), gold_ops.vendor_summary(both))
                        .withColumn("row_id", F.monotonically_increasing_id()))
    matrix, cols = feat_ops.model_matrix(feats, _MF)
    scaled = materialize(feat_ops.standard_scale(matrix, cols))
    runs = [iforest.ForestParams(1, 10, 0.05)]
    scores = iforest.score(scaled, cols, materialize(iforest.fit(scaled, cols, runs)), ("row_id",))
    out = scores.join(feats.select("row_id", "amount"), "row_id")
    return out.agg(F.count("*").alias("rows_out"), F.countDistinct("row_id").alias("distinct_out"),
                   F.sum(F.rint(F.col("amount") * 100).cast("bigint")).cast("bigint").alias("cents_out"),
                   F.count_if(F.col("score") < 0).cast("bigint").alias("scored"))
