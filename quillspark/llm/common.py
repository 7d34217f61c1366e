"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import checkpoint_dir

ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one input table (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under ``spark.checkpoint.dir`` and read back: cuts the lineage, computes
    what several later steps read only once, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """Bound an Arrow batch by bytes, so that very long texts do not meet by the thousand in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)`` with the smallest node as root, one
    row per node that has an edge to another one.

    Alternating large-star and small-star steps: each is one aggregation and one join, the number of
    rounds grows with the logarithm of the longest chain. Minima are combined before the shuffle, and the
    joins are plain sort-merge joins that AQE splits where one node has very many neighbours. Each round
    is written to the shared folder. No edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    seen = None
    while True:
        # large star: every larger neighbour goes to the smallest node around
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        # small star: the node itself and its smaller neighbours go to the smallest of them
        down = big.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = written(star.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
