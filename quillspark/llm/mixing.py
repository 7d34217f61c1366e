"""Mixing sources to target weights by blocks.

Words of a source form one stream (documents in the order of a hash of their id), cut into blocks of
a fixed number of words. Output shards have a fixed number of slots; the slots of a shard are dealt to sources by a
multinomial draw, conditioned on the blocks that each source gives in all, so that totals meet the targets. The j-th
slot of a source takes block perm(j) of a pseudorandom permutation of the source's blocks, a new one for each pass.
Slots and pieces of documents meet in a join on (source, block).

A shard's draw needs no other shard: it descends a binary tree over the shards from the root, splitting the
slots of each source between the halves by hypergeometric draws seeded by the node. So each task makes
its shards alone, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, fresh_name, written

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 42
#: Rows of a source that are summed in one go for the offsets in its stream.
RUN_ROWS = 1024
#: Rows of a table of sources that may be broadcast.
BROADCAST_SOURCES = 100_000

# A word: anything but space and the five ASCII control characters from tab on.
WORD = r"[^\\x20\\x09-\\x0D]+"


def words(text: str) -> Column:
    return F.expr(f"coalesce(cast(regexp_count(`{text}`, '{WORD}') as bigint), 0L)")


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP, total: float | None = None) -> np.ndarray:
    """Words of each source: ``total`` (all sizes) shared by weight; a share above ``cap`` times the source's
    size stops there and the rest is shared again, until none is above."""
    size, weight = np.array(sizes, dtype=np.float64), np.array(weights, dtype=np.float64)
    rest = float(size.sum()) if total is None else total
    out, open_ = np.zeros(len(size)), np.ones(len(size), dtype=bool)
    while open_.any() and rest > 0:
        share = rest * weight / weight[open_].sum()
        over = open_ & (share > cap * size)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap * size[over]
        rest -= out[over].sum()
        open_ &= ~over
    return out


def draws(sizes: Sequence[int], target: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source, slots of each source): whole passes, then the share of one more in blocks."""
    size = np.array(sizes, dtype=np.int64)
    blocks = -(-size // block)
    passes = np.where(size > 0, np.floor(target / np.maximum(size, 1) + 1e-12), 0).astype(np.int64)
    rest = np.rint((target - passes * size) / block).astype(np.int64)
    return blocks, passes * blocks + np.clip(rest, 0, blocks)


def split(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` slots drawn without order from ``counts`` are of each source."""
    out, left, rest = np.zeros_like(counts), int(counts.sum()), take
    for i, n in enumerate(counts.tolist()):
        left -= n
        low, high = max(0, rest - left), min(n, rest)
        if low == high:
            k = low
        elif n + left < 1_000_000_000:
            k = int(rng.hypergeometric(n, left, rest))
        else:  # beyond the generator's range the normal law is right to a millionth
            p = n / (n + left)
            sd = (rest * p * (1 - p) * (1 - rest / (n + left))) ** 0.5
            k = min(high, max(low, round(rest * p + sd * rng.standard_normal())))
        out[i], rest = k, rest - k
    return out


def shard_counts(shard: int, shards: int, slots: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the slots of each source in one shard: the path from the root of the tree to it."""
    first, counts, low, high = np.zeros_like(slots), slots.copy(), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng((seed, low, high)), counts, (mid - low) * shard_slots)
        if shard < mid:
            counts, high = left, mid
        else:
            first, counts, low = first + left, counts - left, mid
    return first, counts


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of ``index`` under pseudorandom permutations of 0..n-1 (elementwise n and key): a four-round
    Feistel network on the next power of four, applied again until the image is below n."""
    n = n.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, key = index.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = x[todo] >> b, x[todo] & m
        for r in range(4):
            h = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@dataclass
class Sources:
    names: list
    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray


def plan(sized: DataFrame, source: str, size: str, weights: Sequence[float], cap: float, block: int) -> Sources:
    """Sizes and targets of the sources, by code point with null last; one row per source reaches the driver."""
    rows = sized.groupBy(source).agg(F.sum(size).alias("n")).collect()
    rows.sort(key=lambda r: (r[0] is None, "" if r[0] is None else str(r[0])))
    sizes = [r["n"] for r in rows]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], cap)
    return Sources([r[0] for r in rows], np.array(sizes, dtype=np.int64), target, *draws(sizes, target, block))


def slot_table(spark, s: Sources, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, src, pass, block): every slot of the mix and the block it takes."""
    total = int(s.slots.sum())
    shards = max(1, -(-total // shard_slots))
    slots, blocks = s.slots, s.blocks

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                first, count = shard_counts(int(shard), shards, slots, shard_slots, seed)
                n = int(count.sum())
                src = np.repeat(np.arange(len(slots)), count)
                j = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + first[src]
                nth = j // np.maximum(blocks[src], 1)
                key = (np.uint64(seed) << np.uint64(40)) + (src.astype(np.uint64) << np.uint64(8)) + nth.astype(np.uint64)
                at = permuted(j % np.maximum(blocks[src], 1), blocks[src], key * np.uint64(0xD6E8FEB86659FD93))
                order = np.random.default_rng((seed, 1, int(shard))).permutation(n)
                yield pd.DataFrame({"shard": int(shard), "slot": np.arange(n), "src": src[order], "pass": nth[order], "block": at[order]})

    tasks = int(min(shards, max(spark.sparkContext.defaultParallelism, shards // 16)))
    return spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, slot long, src int, pass int, block long")


def segments(sized: DataFrame, source: str, size: str, id_: str, row: str, s: Sources, block: int) -> DataFrame:
    """(src, block, row, start, n): the words [start, start + n) of a document lie in that block of its source.

    A document's place in the source's stream is a sum over the rows before it, taken in runs of about
    ``RUN_ROWS`` rows by hash and over the runs' totals: a source of any size is summed by many tasks.
    """
    spark = sized.sparkSession
    named = spark.createDataFrame([(n, i) for i, n in enumerate(s.names)], sized.select(F.col(source).alias("name")).schema.add("src", T.IntegerType()))
    named = F.broadcast(named) if len(s.names) <= BROADCAST_SOURCES else named
    rows = sized.where(F.col(size) > 0).join(named, F.col(source).eqNullSafe(F.col("name")))
    runs = max(1, -(-rows.count() // RUN_ROWS))
    h = F.xxhash64(F.col(id_).cast("string"))
    rows = rows.select("src", F.col(row).alias("row"), F.col(id_).alias("id"), F.col(size).alias("size"), h.alias("h"),
                       F.pmod(h, F.lit(runs)).alias("run"))
    in_run = F.sum("size").over(Window.partitionBy("src", "run").orderBy("h", "id", "size", "row"))
    totals = rows.groupBy("src", "run").agg(F.sum("size").alias("t"))
    base = totals.select("src", "run", (F.sum("t").over(Window.partitionBy("src").orderBy("run")) - F.col("t")).alias("base"))
    at = rows.withColumn("end", in_run).join(base, ["src", "run"])
    at = at.select("src", "row", (F.col("base") + F.col("end") - F.col("size")).alias("from"), (F.col("base") + F.col("end")).alias("to"))
    b = F.lit(block).cast("long")
    cut = at.select("*", F.explode(F.sequence(F.expr(f"`from` div {block}L"), F.expr(f"(`to` - 1) div {block}L"))).alias("block"))
    low, high = F.greatest("from", F.col("block") * b), F.least("to", (F.col("block") + 1) * b)
    return cut.select("src", "block", "row", (low - F.col("from")).alias("start"), (high - low).alias("n"))


@dataclass
class Mix:
    """rows: the documents' rows with their row number and size; plan: sources; blocks: one row per slot
    and piece of a document in its block (shard, slot, src, pass, block, row, start, n)."""

    rows: DataFrame
    plan: Sources
    blocks: DataFrame


def mix(docs: DataFrame, row: str, size: str, weights: Sequence[float] = WEIGHTS, cap: float = CAP, block: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Mix ``docs`` (``doc_id``, ``source`` and the words of each document in ``size``); ``row`` names the column
    that numbers the rows.

    Sources weigh ``weights`` in turn, in the order of their names by code point with null last.
    """
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "sized")
    s = plan(rows, "source", size, weights, cap, block)
    slots = slot_table(docs.sparkSession, s, shard_slots, seed)
    pieces = segments(rows.select("doc_id", "source", row, size), "source", size, "doc_id", row, s, block)
    # as large as the corpus, whatever the planner makes of a range of shards: never broadcast
    return Mix(rows, s, slots.hint("merge").join(pieces, ["src", "block"]))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size: words of the whole text (null or empty: 0); source_size and target: of its source; taken: words of
    the document in the mix, repeats counted, at most three times its size. Null sources are one source. Repeated
    rows are documents of their own. An empty table gives no rows.
    """
    m = mix(docs.select("doc_id", "source", words("text").alias("size")), "row", "size")
    taken = m.blocks.groupBy("row").agg(F.sum("n").alias("taken"))
    named = docs.sparkSession.createDataFrame(
        [(n, int(z), float(t)) for n, z, t in zip(m.plan.names, m.plan.size, m.plan.target)],
        docs.select(F.col("source").alias("name")).schema.add("source_size", T.LongType()).add("target", T.DoubleType()))
    named = F.broadcast(named) if len(m.plan.names) <= BROADCAST_SOURCES else named
    out = m.rows.select("doc_id", "source", "row", "size").join(named, F.col("source").eqNullSafe(F.col("name"))).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@F.pandas_udf(T.StringType())
def _spans(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """The words of the spans of given start and size, rising, as they stand in the text; a gap becomes a line end."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    out = []
    for text, start, size in zip(texts, starts, sizes):
        if text is None:  # taken whole
            out.append(None)
            continue
        at = [m.span() for m in word.finditer(text)]
        runs: list[list[int]] = []
        for a, n in zip(start, size):
            if runs and runs[-1][1] == a:
                runs[-1][1] += n
            else:
                runs.append([a, a + n])
        out.append("\n".join(text[at[a][0] : at[z - 1][1]] for a, z in runs))
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and pass over its source, one row with the words that the pass
    took, in their order. Whole where the pass took every block of it; n_chars is set anew where it exists, other columns
    come back as they were. A document appears at most three times; one without words never."""
    bounded_batches(docs.sparkSession)
    row, size, spans = fresh_name(docs, "row"), fresh_name(docs, "size"), fresh_name(docs, "spans")
    m = mix(docs.withColumn(size, words("text")), row, size)
    taken = m.blocks.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias(spans))
    out = m.rows.join(taken.select(F.col("row").alias(row), spans), row)
    whole = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["n"]) == F.col(size)
    cut = _spans(F.when(~whole, F.col("text")), F.col(spans)["start"], F.col(spans)["n"])
    out = out.withColumn("text", F.coalesce(cut, F.col("text")))
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
