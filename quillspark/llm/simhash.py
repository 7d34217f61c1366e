"""SimHash near-duplicates by ball hashing.

Fingerprints that differ in at most three bits have, in one of their two 32-bit halves, at most one
differing bit - half the radius. So each fingerprint emits, for either half, the half itself and all 32
variants with one bit flipped (66 rows in place of the 2,081 of a whole-word ball of two flips), the rows
are shuffled on the variant, and in a group every fingerprint whose own half is the key is compared in
full with all that reached it. Every pair within the radius meets, and only verified pairs link.

Copies share a fingerprint and are one node. A group returns a spanning forest of its links (fewer rows
than it has members), never its pairs; halves that very many fingerprints share are split once more by
the bytes of the other half, of which a pair within three bits shares at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, connected_components, fresh_name, written

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: A half that more distinct fingerprints share than this is split by bytes of the other half.
HEAVY_HALF = 4096
#: Up to so many heavy halves are broadcast (16 bytes each); beyond it the join is shuffled.
BROADCAST_HALVES = 1_000_000
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, most significant first: a bit is 1 if set in over half of the shingles' hashes (XXH64,
    seed 42, of the words joined by a space). Only A-Z are lower-cased and only ASCII white space parts
    words; fewer words than a shingle needs are one shingle, no words give zero."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return bytes(8)
    shingles = zip(*(words[k:] for k in range(shingle_words))) if len(words) >= shingle_words else [words]
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = np.frombuffer(b"".join([digest(join(s), SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(hashes[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes)).tobytes()


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.frombuffer(b"".join(map(fingerprint, texts)), dtype=">i8").astype(np.int64))


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` plus the fingerprint of the whole text as a signed long."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, _fingerprints(F.col(text)))


def _half(fp: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The 32 bits that half 0 (high) or 1 (low) of a fingerprint holds."""
    u = fp.astype(np.uint64)
    return np.where(which == 0, u >> np.uint64(32), u & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, fp): for each half, the half and its one-bit variants; the key's bit 32 tells the halves apart."""
    flips = np.array([0] + [1 << b for b in range(32)], dtype=np.int64)
    for part in parts:
        fp = part["fp"].to_numpy(np.int64)
        for at in range(0, len(fp), CHUNK // 8):
            some = fp[at : at + CHUNK // 8]
            keys = [((_half(some, np.int64(h))[:, None] ^ flips) | (h << 32)).ravel() for h in (0, 1)]
            yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.tile(np.repeat(some, 33), 2)})


def _forest(key: int, members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links between fingerprints whose own half is the key and all members of the group, as the edges of
    stars: each member and the first of its component in the group."""
    own = members[_half(members, np.int64(key >> 32)) == (key & 0xFFFFFFFF)]
    label = np.arange(len(members))
    for center in own:
        near = label[np.bitwise_count((members ^ center).astype(np.uint64)) <= radius]
        if near.min() != near.max():
            label[np.isin(label, near)] = near.min()
    for i in np.flatnonzero(label != np.arange(len(members))):
        yield int(members[i]), int(members[label[i]])


def _verify(radius: int):
    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key: groups are runs of rows; the last run of a batch goes on in the next."""
        rest = None
        for part in _then_end(parts):
            if part is None:
                block, last = rest, True
            else:
                block, last = (part if rest is None else pd.concat([rest, part], ignore_index=True)), False
            if block is None or not len(block):
                continue
            key, sub = block["key"].to_numpy(np.int64), block["sub"].to_numpy(np.int64)
            fp = block["fp"].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
            ends = np.r_[starts[1:], len(key)]
            if not last:
                rest = block.iloc[starts[-1] :].reset_index(drop=True)
                starts, ends = starts[:-1], ends[:-1]
            own = _half(fp, key >> 32) == (key & 0xFFFFFFFF)
            has_own = np.add.reduceat(own, starts) > 0 if len(starts) else np.zeros(0, bool)
            edges = [e for a, z in zip(starts[has_own & (ends - starts > 1)], ends[has_own & (ends - starts > 1)])
                     for e in _forest(int(key[a]), np.unique(fp[a:z]), radius)]
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return links


def _then_end(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from parts
    yield None


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that span the same components as all pairs
    within ``radius`` (at most 3) bits."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves with one flipped bit cover radii up to 3")
    spark = fps.sparkSession
    halves = F.explode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF).bitwiseOR(1 << 32)))
    heavy = written(fps.select(halves.alias("key")).groupBy("key").count().where(F.col("count") > HEAVY_HALF).select("key"), "heavy")
    rows = fps.mapInPandas(_emit, "key long, fp long")
    n_heavy = heavy.count()
    if n_heavy:
        mark = heavy.withColumn("split", F.lit(True))
        rows = rows.join(F.broadcast(mark) if n_heavy <= BROADCAST_HALVES else mark, "key", "left")
        other = F.when(F.shiftright("key", 32) == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
        byte = [F.lit(1 + (k << 8)) + F.shiftright(other, 8 * k).bitwiseAND(255) for k in range(4)]
        subs = F.when(F.col("split"), F.array(*byte)).otherwise(F.array(F.lit(0).cast("long")))
        rows = rows.select("key", F.explode(subs).alias("sub"), "fp")
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("sub"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "sub").sortWithinPartitions("key", "sub").mapInPandas(_verify(radius), "a long, b long").distinct()


def fingerprint_classes(hashed: DataFrame, id_col: str, radius: int = RADIUS, *more: str) -> DataFrame:
    """(fp, component_id): every distinct fingerprint and the smallest id that its links reach; ``more`` may ask for
    ``root``, the smallest fingerprint of the component."""
    classes = written(hashed.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    stars = connected_components(fingerprint_links(classes.select("fp"), radius), "a", "b")
    at = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at = written(at, "roots")
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    return at.join(least, "root").select("fp", "component_id", *more)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id.

    Null and empty texts have fingerprint zero and link like others. Repeated rows come back as often as
    they go in. Null ids are never the smallest; a component without any other has a null component_id.
    Very long texts are hashed whole. Only doc_id and text are read. An empty table gives no rows.
    """
    hashed = written(with_fingerprint(docs.select("doc_id", "text"), "text", "fp").drop("text"), "fingerprints")
    out = hashed.join(fingerprint_classes(hashed, "doc_id", radius), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (null last), ties to the
    smaller fingerprint and then to the first row. All columns come back as they were.

    Rows are numbered in the written table, so the texts are shuffled once, to meet the numbers that stay.
    """
    fp, row = fresh_name(docs, "fp"), fresh_name(docs, "row")
    hashed = written(with_fingerprint(docs, "text", fp).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    small = hashed.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    classes = fingerprint_classes(small, "doc_id", radius, "root")
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row")
    # combined per fingerprint first: a text that a third of the rows share is one row per task
    first = small.groupBy("fp").agg(F.min(best).alias("best")).join(classes, "fp").groupBy("root").agg(F.min("best").alias("best"))
    return hashed.join(first.select(F.col("best.row").alias(row)), row, "left_semi").select(*docs.columns)
