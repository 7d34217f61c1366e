"""Streaming bronze ingest with Structured Streaming.

Messages are JSON event envelopes ``{event_type, event_timestamp, source_system, payload}``
keyed by vendor_id; a bare payload without envelope is accepted too. The same bronze
projection as the batch path is applied (batch/stream parity), and the file sink plus a
checkpoint directory gives exactly-once output: a restart resumes from the committed
offsets and adds no rows.

Sources: a Kafka topic when the connector is on the classpath (``kafka_source``), or a folder
of JSON-lines files (tests, replays). Both are throttled per micro-batch
(``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``) and can drain what is available and stop
(``availableNow``), which replaces the "stop after 30 s of silence" loop.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from quillspark.config import EVENT_SOURCE_SYSTEM, EVENT_TYPE, STREAM_SOURCE
from quillspark.operators.bronze import add_metadata
from quillspark.sources.fixtures import RAW_COLUMNS

# Longest wait, after a query has ended, for the reports of its micro-batches that are still under way.
REPORT_SECONDS = 60
# Messages that a published file aims at: one task sorts and writes it.
FILE_ROWS = 250_000

RAW_SCHEMA = T.StructType([
    T.StructField("invoice_id", T.StringType()), T.StructField("vendor_id", T.StringType()),
    T.StructField("vendor_name", T.StringType()), T.StructField("invoice_date", T.StringType()),
    T.StructField("due_date", T.StringType()), T.StructField("amount", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.StringType()),
])
# Envelope fields plus the payload fields at top level, so one parse accepts both shapes.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("event_timestamp", T.StringType()),
    T.StructField("source_system", T.StringType()), T.StructField("payload", RAW_SCHEMA),
    *RAW_SCHEMA.fields,
])


def envelope_text(event_time: dt.datetime) -> Column:
    """The JSON envelope of a raw invoice row. A missing amount is sent as NaN, as the source feed does, so the
    stream fingerprint equals the batch one."""
    payload = F.struct(*[(F.coalesce(F.col("amount"), F.lit(float("nan"))) if c == "amount" else F.col(c)).alias(c)
                         for c in RAW_COLUMNS])
    msg = F.struct(F.lit(EVENT_TYPE).alias("event_type"),
                   F.lit(event_time.isoformat()).alias("event_timestamp"),
                   F.lit(EVENT_SOURCE_SYSTEM).alias("source_system"),
                   payload.alias("payload"))
    return F.to_json(msg)


def envelope(raw: DataFrame, event_time: dt.datetime) -> DataFrame:
    """(key, value): key = vendor_id (per-key ordering in a partitioned topic), value = JSON envelope."""
    return raw.select(F.col("vendor_id").alias("key"), envelope_text(event_time).alias("value"))


def unwrap(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON text -> raw invoice columns: the payload when an envelope is present, else the message itself."""
    m = F.from_json(F.col(value_col).cast("string"), MESSAGE_SCHEMA, {"allowNonNumericNumbers": "true"}).alias("m")
    parsed = messages.select(m)
    bare = F.struct(*[F.col(f"m.{c}").alias(c) for c in RAW_COLUMNS])
    return parsed.select(F.coalesce(F.col("m.payload"), bare).alias("p")).select("p.*")


def stream_bronze_frame(messages: DataFrame, ingested_at: dt.datetime) -> DataFrame:
    """The shared bronze projection for a (streaming or batch) DataFrame of messages."""
    return add_metadata(unwrap(messages), ingested_at, STREAM_SOURCE)


def publish_files(raw: DataFrame, path: str, event_time: dt.datetime, files: int | None = None,
                  max_messages: int | None = None, file_rows: int = FILE_ROWS) -> int:
    """Keyed publish to a folder of JSON-lines files (the file stand-in for a topic; one line per message).

    Messages are hash-partitioned by key, so each vendor's messages stay in one file, ordered by created_at and
    invoice_id. Without ``files`` there are as many as the data need (the session's shuffle partitions, small ones
    merged by AQE). ``max_messages`` sends only the first n invoices by id (the producer's demo limit); default all.

    A file is sorted and written by one task. So each of ``files`` is cut by key into as many parts of about ``file_rows``
    messages as it needs, the same number for all; that number is returned. A reader that takes so many files at a time
    (``file_source(max_files=...)``) has ``files`` micro-batches whatever the number of messages.
    """
    src = raw.orderBy("invoice_id").limit(max_messages) if max_messages else raw
    env = src.select("created_at", "invoice_id", F.col("vendor_id").alias("key"), envelope_text(event_time).alias("value"))
    parts = max(1, -(-(max_messages or raw.count()) // (files * file_rows))) if files else 1
    env = env.repartition(files * parts, "key") if files else env.repartition("key")
    env.sortWithinPartitions("key", "created_at", "invoice_id").select("value").write.mode("overwrite").text(path)
    return parts


def publish_kafka(raw: DataFrame, servers: str, topic: str, event_time: dt.datetime) -> None:
    """Keyed publish to a Kafka topic (key = vendor_id keeps each vendor's messages in one topic
    partition, in order). Needs the spark-sql-kafka connector on the classpath."""
    (envelope(raw, event_time).write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int = 10) -> DataFrame:
    """Kafka subscription from the earliest offset, ``max_offsets`` messages per micro-batch.
    Needs the spark-sql-kafka connector on the classpath."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", max_offsets).load())


def file_source(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


@dataclass
class StreamResult:
    output: str
    batches: int
    rows_read: int


def run_stream_bronze(messages: DataFrame, output: str, checkpoint: str, ingested_at: dt.datetime,
                      query_name: str | None = None) -> StreamResult:
    """Drain the available messages into bronze Parquet and stop (``availableNow``); exactly once
    through the checkpoint. Returns the progress counters (micro-batches, messages read)."""
    bronze = stream_bronze_frame(messages, ingested_at)
    w = (bronze.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True))
    if query_name:
        w = w.queryName(query_name)
    return StreamResult(output, *_counted(messages.sparkSession, w))


class _Progress(StreamingQueryListener):
    """Rows of every micro-batch of every run, as Spark reports them one by one; the end of a run comes after all its batches."""

    def __init__(self):
        self.rows: dict[str, dict[int, int]] = defaultdict(dict)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = self.rows[str(p.runId)]
        rows[p.batchId] = max(rows.get(p.batchId, 0), p.numInputRows)

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


def _counted(spark: SparkSession, writer: DataStreamWriter) -> tuple[int, int]:
    """Start a query and wait for its end; (micro-batches with rows, rows read), however many micro-batches there are: each
    is counted when it is reported, not read from the short list of recent ones. A query that fails raises its own error."""
    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        q = writer.start()
        q.awaitTermination()
        progress.ended[str(q.runId)].wait(REPORT_SECONDS)
        rows = progress.rows[str(q.runId)]
    finally:
        spark.streams.removeListener(progress)
    return sum(n > 0 for n in rows.values()), sum(rows.values())


def run_stream_bronze_batches(messages: DataFrame, output: str, checkpoint: str, ingested_at: dt.datetime) -> StreamResult:
    """Same as ``run_stream_bronze`` but each micro-batch lands in its own folder ``batch_<id>``
    (``foreachBatch``). A replayed batch id overwrites its folder, so a restart never duplicates rows."""
    bronze = stream_bronze_frame(messages, ingested_at)
    base = output.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch_{batch_id:06d}")

    w = bronze.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return StreamResult(output, *_counted(messages.sparkSession, w))


def progress_frame(spark: SparkSession, result: StreamResult) -> DataFrame:
    return spark.createDataFrame([(result.batches, result.rows_read)], "batches_written long, messages_read long")
