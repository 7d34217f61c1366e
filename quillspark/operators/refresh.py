"""Vector table refresh: only texts that the last snapshot does not hold are embedded, and readers switch snapshots at once.

A refresh writes a whole snapshot (every row with its vector) to a folder of its own. Vectors of known texts are taken over by the
hash of the text; every other distinct text is embedded once. A manifest row, written after the snapshot, names it: readers
take the newest manifest, so they see the old snapshot or the new one, never a part, and a refresh that dies leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH = "text_hash"
MANIFEST = "version long, folder string, n_rows long, embedded long"


@dataclass(frozen=True)
class Snapshot:
    version: int
    folder: str
    rows: int
    embedded: int


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The newest snapshot; None before the first refresh. A row per refresh is read."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/*").orderBy(F.col("version").desc()).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if found is None else Snapshot(*found)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest snapshot."""
    now = current(spark, root)
    if now is None:
        raise ValueError(f"no snapshot below {root}")
    return spark.read.parquet(now.folder)


def refresh(rows: DataFrame, text_col: str, root: str, embed: Callable[[DataFrame], DataFrame]) -> Snapshot:
    """Make ``rows`` the newest snapshot, with ``text_hash`` and ``embedding``; rows that are gone are gone from it, equal texts
    share a vector. ``embed`` turns (text_hash, <text_col>) into (text_hash, embedding). Null texts count as empty ones.

    Two joins on the hash; equal texts are combined before they meet, so a text that a third of the rows share is one row there,
    and AQE splits the rows that share it.
    """
    spark, old = rows.sparkSession, current(rows.sparkSession, root)
    version = 1 if old is None else old.version + 1
    folder = f"{root}/snapshot-{version:06d}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = rows.withColumn(HASH, F.sha2(text, 256))
    texts = hashed.groupBy(HASH).agg(F.first(text).alias(text_col))
    if old is not None:
        known = spark.read.parquet(old.folder).select(HASH, "embedding").dropDuplicates([HASH])
        texts = texts.join(known.select(HASH), HASH, "left_anti")
    fresh_folder = f"{root}/fresh-{version:06d}"
    embed(texts).select(HASH, "embedding").write.mode("overwrite").parquet(fresh_folder)
    fresh = spark.read.parquet(fresh_folder)
    vectors = fresh if old is None else fresh.unionByName(known)
    hashed.join(vectors, HASH).write.mode("overwrite").parquet(folder)
    made = Snapshot(version, folder, spark.read.parquet(folder).count(), fresh.count())
    spark.createDataFrame([(made.version, made.folder, made.rows, made.embedded)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{version:06d}")
    return made
