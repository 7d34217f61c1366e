"""Source divergence audit: which terms set a source apart from its language, and how far sources lie from one another.

Counting is a token-start pointer sort: a shard of texts is one byte buffer of Arrow, a pointer stands at every start of a term, and
a multikey quicksort orders the pointers by eight-byte slices of what they point to: pointers that agree in a slice and go
on stay together and are ordered by their next slice. Runs of equal terms then tell a term's occurrences and documents per
source at once. Shards' counts are added up by Spark; no term is left out before all shards are in.

Shares are whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)). The sums over all kept terms for every pair of
sources are taken in blocks of terms, each block by numpy over its postings: terms that neither source has follow from
counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, written

#: Text bytes of a shard (more where one text is longer).
SHARD_BYTES = 6 << 20
#: Slices that are ordered by numpy; what still agrees after them (terms beyond 64 bytes) is ordered as bytes.
SLICES = 8
#: Postings that a block of terms aims at, and sums of pairs of sources that a task holds at most.
BLOCK_POSTINGS = 250_000
PAIRS = 1_000_000
TOP = 200
LEAST_DOCS = 3

ONE = 1_000_000_000
# ASCII letters and all bytes of other characters make terms; A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True

COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, source string, part string, item string, value long"


def pointer_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the terms data[start : start + length], and whether each in that order is the first of its run of equal terms.
    Equal terms stay in the order given."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def slices(at: np.ndarray, depth: int) -> np.ndarray:
        left = np.minimum(length[at] - depth, 8)
        key = windows[np.minimum(start[at] + depth, len(data))].copy().view(">u8").ravel().astype(np.uint64)
        drop = (8 * (8 - left)).astype(np.uint64)
        return np.where(left > 0, (key >> np.minimum(drop, 63)) << np.minimum(drop, 63), 0)  # left >= 1: drop <= 56

    n = len(start)
    order = np.arange(n)
    first = np.zeros(n, dtype=bool)
    if n:
        first[0] = True
    places, run = np.arange(n), np.zeros(n, dtype=np.int64)
    for level in range(SLICES):
        if not len(places):
            return order, first
        key = slices(order[places], 8 * level)
        by = np.lexsort((key, run)) if level else np.argsort(key, kind="stable")
        order[places], key, run = order[places][by], key[by], run[by]
        new = np.r_[True, (key[1:] != key[:-1]) | (run[1:] != run[:-1])]
        first[places] |= new
        run = np.cumsum(new)
        # go on with runs of several pointers whose slice is full
        more = ((key & np.uint64(255)) != 0) & (np.bincount(run)[run] > 1)
        places, run = places[more], run[more]
    if len(places):
        tails = [data[start[i] + 8 * SLICES : start[i] + length[i]].tobytes() for i in order[places]]
        by = sorted(range(len(places)), key=lambda i: (run[i], tails[i]))
        order[places] = order[places][by]
        new = [k == 0 or run[by[k]] != run[by[k - 1]] or tails[by[k]] != tails[by[k - 1]] for k in range(len(by))]
        first[places] |= np.array(new)
    return order, first


def count_shard(group: np.ndarray, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of every term and group of a shard: ``group`` numbers the (lang, source) of each text."""
    by = np.argsort(group, kind="stable")  # equal terms then lie by group, and by document within it
    texts, group = texts.take(pa.array(by)), group[by]
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data, inside = LOWER[raw], IN_TERM[raw]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    order, first = pointer_sort(data, start, end - start)
    if not len(order):
        return pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3
    term = np.cumsum(first)
    d, g = doc[order], group[doc[order]]
    rows = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (g[1:] != g[:-1])])
    new_doc = np.r_[True, (term[1:] != term[:-1]) | (d[1:] != d[:-1])]
    at = order[rows]
    size = end[at] - start[at]
    bounds = np.r_[0, np.cumsum(size)]
    where = np.repeat(start[at] - bounds[:-1], size) + np.arange(bounds[-1])
    names = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[where]))
    return names, g[rows], np.diff(np.r_[rows, len(order)]), np.add.reduceat(new_doc.astype(np.int64), rows)


def term_counts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``COUNTS``: occurrences of each term in the documents of each (lang, source), and how many of these hold it. Null
    text, lang and source count as ''."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def counted(shard: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(shard)
        names = t.select(["lang", "source"]).group_by(["lang", "source"]).aggregate([])
        number = {k: i for i, k in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
        group = np.array([number[k] for k in zip(t["lang"].to_pylist(), t["source"].to_pylist())], dtype=np.int64)
        texts = pc.cast(t["text"], pa.large_string()).combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        term, g, n, d = count_shard(group, texts)
        langs, sources = names["lang"].combine_chunks(), names["source"].combine_chunks()
        for a in range(0, len(term), 1 << 16):
            s = slice(a, a + (1 << 16))
            at = pa.array(g[s])
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), pc.cast(term[s], pa.string()), pa.array(n[s]), pa.array(d[s])],
                                             names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for batch in batches:
            shard.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                yield from counted(shard)
                shard, size = [], 0
        if shard:
            yield from counted(shard)

    return rows.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly: long division by three digits at a time."""
    out, rest = np.divmod(np.asarray(count, np.int64) + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def block_sums(source: np.ndarray, term: np.ndarray, p: np.ndarray, none: np.ndarray, mine: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each source a of ``mine``: the sums over the block's terms of distance(p of a, p of b), for every source b.

    Postings are (source, term, p), by term; ``none`` is the p of each source for a term that it does not have. The sum is taken as if
    neither had any term, corrected for the terms of a, for those of b, and for those of both. Whole numbers wrap around
    on the way and end up right, since every sum fits.
    """
    indptr = np.searchsorted(term, np.arange(term[-1] + 2)) if len(term) else np.zeros(1, np.int64)
    terms = len(indptr) - 1
    pairs, often = np.unique(np.stack([source, p], axis=1), axis=0, return_counts=True)
    by_source = np.argsort(source, kind="stable")
    ends = np.searchsorted(source[by_source], np.arange(len(none) + 1))
    for a in mine:
        base = distance(none[a], none)
        total = terms * base
        np.add.at(total, pairs[:, 0], often * (distance(none[a], pairs[:, 1]) - base[pairs[:, 0]]))
        own = by_source[ends[a] : ends[a + 1]]
        values, times = np.unique(p[own], return_counts=True)
        for v, k in zip(values, times):
            total += k * (distance(v, none) - base)
        first, size = indptr[term[own]], indptr[term[own] + 1] - indptr[term[own]]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        b, pb, pa_ = source[at], p[at], np.repeat(p[own], size)
        np.add.at(total, b, distance(pa_, pb) - distance(pa_, none[b]) - distance(none[a], pb) + base[b])
        yield a, total


def _block(top: int):
    """One block of a language's kept terms and one slab of its sources: partial sums of pairs, and the best terms of each source."""

    def block(key: tuple, postings: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        lang, _, slab = key
        groups = groups.sort_values("number")
        names, whole = groups["source"].to_numpy(), groups["N"].to_numpy(np.int64) + groups["V"].to_numpy(np.int64)
        if not len(groups) or not whole.any():  # a language without kept terms: sums are 0
            whole = np.ones(len(groups), np.int64)
        width = max(1, PAIRS // max(1, len(names)))
        mine = range(int(slab) * width, min((int(slab) + 1) * width, len(names)))
        postings = postings.sort_values("term")
        words, term = np.unique(postings["term"].to_numpy(object), return_inverse=True) if len(postings) else (np.zeros(0, object), np.zeros(0, np.int64))
        by = np.argsort(term, kind="stable")
        postings, term = postings.iloc[by], term[by]
        source = pd.Index(names).get_indexer(postings["source"]) if len(postings) else np.zeros(0, np.int64)
        n = postings["n"].to_numpy(np.int64)
        p, none = share(n, whole[source]), share(np.zeros(len(names), np.int64), whole)
        out = []
        for a, total in block_sums(source, term, p, none, mine):
            other = np.arange(len(names)) != a
            out.append(pd.DataFrame({"source": names[a], "part": "pair", "item": names[other], "value": total[other]}))
        if len(postings):
            q = share(postings["total"].to_numpy(np.int64), np.int64(groups["NL"].iloc[0] + groups["V"].iloc[0]))
            best = pd.DataFrame({"source": source, "item": words[term], "value": distance(p, q), "term": term})
            best = best[(p > q) & (source >= mine.start) & (source < mine.stop)]
            best = best.sort_values(["source", "value", "term"], ascending=[True, False, True]).groupby("source").head(top)
            out.append(pd.DataFrame({"source": names[best["source"]], "part": "term", "item": best["item"], "value": best["value"]}))
        if not out:
            return pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "value": pd.Series([], dtype="int64")})
        return pd.concat(out).assign(lang=lang)[["lang", "source", "part", "item", "value"]]

    return block


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs`` (text, lang, source): part ``pair`` holds the
    sums against each other source of the language, part ``term`` the ``top`` terms whose share there is above the language's.

    Nulls count as ''. Repeated rows count as often as they come, each a document; very long texts count whole. Ties rank by
    the bytes of the item. A language without kept terms has pairs of value 0, one with a single source no pairs. Other columns
    are not read. An empty table gives no rows.
    """
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("df", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term))
    counts = counts.withColumn("leads", (F.min("source").over(term) == F.col("source")).cast("int"))
    kept = written(counts.where(F.col("df") >= least_docs).select("lang", "source", "term", "n", "total", "leads"), "postings")

    langs = kept.groupBy("lang").agg(F.sum("leads").alias("V"), F.sum("n").alias("NL"), F.count("*").alias("postings"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["N", "V", "NL", "postings"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("number", F.row_number().over(by_lang.orderBy("source"))).withColumn("sources", F.count("*").over(by_lang))
    groups = groups.withColumn("blocks", F.expr(f"greatest(1L, (postings + {block_postings - 1}) div {block_postings})"))
    groups = groups.withColumn("last_slab", F.expr(f"cast((sources - 1) div greatest(1L, {PAIRS} div sources) as int)"))
    groups = written(groups, "groups")

    plan = groups.where("number = 1").select("lang", "blocks", "last_slab")
    slabs = F.explode(F.sequence(F.lit(0), "last_slab"))
    dealt = kept.join(plan, "lang").withColumn("block", F.expr("pmod(xxhash64(term), blocks)")).withColumn("slab", slabs)
    spread = groups.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("slab", slabs)
    keys = ["lang", "block", "slab"]
    sums = dealt.select(*keys, "source", "term", "n", "total").groupBy(*keys).cogroup(
        spread.select(*keys, "source", "number", "N", "V", "NL").groupBy(*keys)).applyInPandas(_block(top), SUMS)
    sums = written(sums, "sums")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = sums.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = sums.where("part = 'term'")
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= top))
