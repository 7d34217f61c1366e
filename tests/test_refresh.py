"""Vector refresh: only changed texts are embedded, snapshots switch at once; and stream counters over very many micro-batches."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import refresh, vectors
from quillspark.session import scratch_path
from quillspark.streaming import ingest


def embed(t):
    return vectors.hashed_bow(t, refresh.HASH, "text")


def rows(df):
    return sorted((r.id, r.text, tuple(r.embedding)) for r in df.select("id", F.coalesce("text", F.lit("")).alias("text"), "embedding").collect())


def test_one_percent_changed_embeds_one_percent(spark):
    root = scratch_path(spark, "vectors")
    base = spark.range(1000).selectExpr("id", "concat('text number ', id) text")
    first = refresh.refresh(base, "text", root, embed)
    assert (first.version, first.rows, first.embedded) == (1, 1000, 1000)
    changed = base.withColumn("text", F.expr("if(id % 100 = 7, concat('new ', text), text)")).where("id <> 5")
    second = refresh.refresh(changed, "text", root, embed)
    assert (second.version, second.rows, second.embedded) == (2, 999, 10)
    assert rows(refresh.read(spark, root)) == rows(vectors.hashed_bow(changed, "id", "text", keep=["text"]))
    third = refresh.refresh(changed, "text", root, embed)
    assert (third.version, third.rows, third.embedded) == (3, 999, 0)


def test_copies_nulls_and_empty_tables(spark):
    root = scratch_path(spark, "vectors")
    base = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, ""), (4, "")], "id long, text string")
    assert refresh.refresh(base, "text", root, embed).embedded == 2
    assert [r[0] for r in rows(refresh.read(spark, root))] == [1, 2, 3, 4, 4]
    assert refresh.refresh(base.limit(0), "text", root, embed).rows == 0
    assert refresh.read(spark, root).count() == 0


def test_a_refresh_that_fails_leaves_the_old_snapshot(spark):
    root = scratch_path(spark, "vectors")
    assert refresh.current(spark, root) is None
    with pytest.raises(ValueError, match="no snapshot"):
        refresh.read(spark, root)
    base = spark.createDataFrame([(1, "a")], "id long, text string")
    refresh.refresh(base, "text", root, embed)
    before = rows(refresh.read(spark, root))

    def broken(t):
        return embed(t).withColumn("embedding", F.expr("if(true, cast(raise_error('no model') as array<double>), embedding)"))

    with pytest.raises(Exception, match="no model"):
        refresh.refresh(spark.createDataFrame([(1, "b")], "id long, text string"), "text", root, broken)
    assert rows(refresh.read(spark, root)) == before and refresh.current(spark, root).version == 1


def test_two_hundred_micro_batches_are_counted(spark):
    topic = scratch_path(spark, "topic")
    spark.range(200).select(F.col("id").cast("string").alias("value")).repartitionByRange(200, F.col("value").cast("long")).write.text(topic)
    files = len([f for f in spark.read.text(topic).select(F.input_file_name().alias("f")).distinct().collect()])
    w = ingest.file_source(spark, topic, 1).writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True)
    batches, read = ingest._counted(spark, w)
    assert files > 150 and (batches, read) == (files, 200)
