"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, written
from quillspark.llm.tokens import word_encoder

BUCKET = 1024


def length_histogram(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(length, n_docs): documents by number of ids of the whole text; null and empty texts have length 0.
    Counts are combined before the shuffle, so a common length costs one row per task."""
    bounded_batches(docs.sparkSession)
    encoder = word_encoder(docs.sparkSession, tokenizer_path)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(encode(t)) // 4 for t in batch.column(0).to_pylist()], pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(lengths, "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def length_table(histogram: DataFrame) -> DataFrame:
    """Answers for every limit L that occurs as a length, from running sums over the histogram alone:

    - n_docs: documents of exactly L tokens; docs_up_to, tokens_up_to: those of at most L, and their tokens;
    - docs_over, tokens_over: those of more than L; truncated_total: tokens left when every document is cut
      to L; quantile: share of documents of at most L.

    A limit between two lengths is answered from the row of the next smaller length
    (``truncated_at``). Running sums are taken within buckets of 1024 lengths and over bucket totals, so no
    task sees more than the longest length / 1024 rows or one bucket. An empty histogram gives no rows.
    """
    h = histogram.withColumn("b", F.floor(F.col("length") / BUCKET)).withColumn("t", F.col("length") * F.col("n_docs"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt")).select(
        "b", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(total).alias("dn"), F.sum("bt").over(total).alias("tn"))
    upto = Window.partitionBy("b").orderBy("length")
    r = h.join(base, "b").withColumn("docs_up_to", F.col("d0") + F.sum("n_docs").over(upto)) \
        .withColumn("tokens_up_to", F.col("t0") + F.sum("t").over(upto))
    over = F.col("dn") - F.col("docs_up_to")
    return r.select("length", "n_docs", "docs_up_to", "tokens_up_to", over.alias("docs_over"),
                    (F.col("tn") - F.col("tokens_up_to")).alias("tokens_over"),
                    (F.col("tokens_up_to") + over * F.col("length")).alias("truncated_total"),
                    (F.col("docs_up_to") / F.col("dn")).alias("quantile"))


def truncated_at(lengths: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to ``limit`` tokens (0 for no documents)."""
    low = lengths.where(F.col("length") <= limit).agg(F.max_by("tokens_up_to", "length").alias("t"), F.max("docs_up_to").alias("d"))
    n = lengths.agg(F.sum("n_docs").alias("n"))
    docs = F.coalesce("n", F.lit(0)) - F.coalesce("d", F.lit(0))
    return low.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").select(
        (F.coalesce("t", F.lit(0)) + docs * limit).alias("truncated_total"))


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``length_table`` of all documents (column ``text``; other columns are not read). Repeated rows count
    as often as they come; an empty table gives no rows."""
    return length_table(written(length_histogram(docs, tokenizer_path), "lengths"))
