"""Language-model scores from a log-frequency Bloom filter, beside exact unigram scores.

One pass over the corpus hashes every word and writes a token row per batch of documents: its distinct words and the places
of its tokens among them. From these rows each batch sends to each bucket of the hash space two packed rows: its distinct
words and its distinct bigrams, each once with its count, however many of the documents hold it. A bucket then knows the exact corpus counts of its words, returns them to each batch, and packs all its words and
bigrams into its segment of the filter: a key of count c enters once for every level up to
log(c), so the number of levels that test positive gives back the count, and an overestimate needs one false
positive more for every level.

A segment has the size that its keys ask for, so the filter grows with the corpus without bound. It never leaves
its bucket: the keys of a batch meet it there and go back as levels, one byte each, to the token row of the batch. Corpus counts, vocabulary and sums cover all training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, remainder, written

#: Words per bucket that the number of buckets aims at, and the least number of buckets.
BUCKET_WORDS = 3_000_000
LEAST_BUCKETS = 64
#: The filter: bytes per corpus word, and bits that every key has at least.
FILTER_BYTES_PER_WORD = 0.5
BITS_PER_KEY = 8
HASHES = 4
#: Counts are kept as levels that start at the distinct whole numbers among the rounded-up powers of BASE.
BASE = 1.2
STARTS = np.unique(np.ceil(BASE ** np.arange(240) - 1e-9))
#: Keys that are hashed in one go.
CHUNK = 1 << 18
#: Share of the probability that the bigram has.
BIGRAM_SHARE = 0.2
END_OF_TEXT = xxhash.xxh64_intdigest(b"\n")  # no word holds white space

LOW = np.uint64((1 << 48) - 1)
MASK32 = np.uint64(0xFFFFFFFF)
#: Token rows: ids, flags and numbers of tokens of the documents; distinct hashes, frequent ones first; places of the tokens.
TOKENS = "batch long, ids binary, flags binary, sizes binary, own binary, places binary"
PACKED = "bucket int, kind string, batch long, a binary, b binary"


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, A-Z lower-cased, parted by ASCII white space; then the end."""
    words = (text or "").encode("utf-8").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out[-1] = END_OF_TEXT
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbours."""
    return mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def pack6(h: np.ndarray) -> bytes:
    """The low six bytes of each hash; the bucket has the high bits."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def levels(count: np.ndarray) -> np.ndarray:
    """Level of a count of at least 1: 1, 2, ..."""
    return np.searchsorted(STARTS, count, side="right")


def level_counts() -> np.ndarray:
    """The count that each level stands for: the geometric mean of its least and largest; level 0 is 0."""
    return np.r_[0.0, np.sqrt(STARTS * (np.r_[STARTS[1:], 2 * STARTS[-1]] - 1))]


def key_hash(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the places of a key at a level."""
    x = mixed(h + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    return x & MASK32, (x >> np.uint64(32)) | np.uint64(1)


def bit_place(start: np.ndarray, step: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place in a segment of ``bits`` bits (below 2 ** 32)."""
    return ((((start + step * np.uint64(k)) & MASK32) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def segment_size(counts: np.ndarray, least: int) -> int:
    """Bytes of the segment that takes keys of these counts with BITS_PER_KEY bits for every level."""
    return max(least, -(-int(levels(counts).sum()) * BITS_PER_KEY // 8))


def fill_segment(words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, size: int) -> bytes:
    """Bits of one bucket's segment of ``size`` bytes, with every key of a count of at least 1."""
    keys, level = np.concatenate([words, pairs]), levels(np.concatenate([word_counts, pair_counts]))
    bits = np.zeros(8 * size, dtype=np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= j]
        for at in range(0, len(some), CHUNK):
            start, step = key_hash(some[at : at + CHUNK], j)
            for k in range(HASHES):
                bits[bit_place(start, step, k, 8 * size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def probe_levels(h: np.ndarray, filter_: np.ndarray, shift: int, size: int) -> np.ndarray:
    """Level that the filter gives each hash: levels are probed upwards until one is missing."""
    if len(h) > CHUNK:
        return np.concatenate([probe_levels(h[at : at + CHUNK], filter_, shift, size) for at in range(0, len(h), CHUNK)])
    base = (h >> np.uint64(shift)).astype(np.int64) * size
    level, active = np.zeros(len(h), dtype=np.int64), np.arange(len(h))
    j = 0
    while len(active):
        j += 1
        start, step = key_hash(h[active], j)
        for k in range(HASHES):  # most absent keys miss their first bits
            at = bit_place(start, step, k, 8 * size)
            hit = np.flatnonzero((filter_[base[active] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1)
            active, start, step = active[hit], start[hit], step[hit]
        level[active] = j
    return np.minimum(level, len(STARTS)).astype("u1")


def probe(h: np.ndarray, filter_: np.ndarray, shift: int, size: int) -> np.ndarray:
    """Count that the filter gives each hash."""
    return level_counts()[probe_levels(h, filter_, shift, size)]


def kept_bits(bits: int) -> np.uint64:
    """The bits of a hash that its bucket and its low six bytes hold."""
    shift = 64 - bits
    return np.uint64((1 << 64) - 1) if shift <= 48 else ~np.uint64(((1 << shift) - 1) ^ ((1 << 48) - 1))


def pack_order(order: np.ndarray) -> bytes:
    """Places of the tokens, compressed: the low bytes of all, the next bytes of all, and so on."""
    return zlib.compress(np.ascontiguousarray(order.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_order(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A token row (``TOKENS``) per Arrow batch of (doc_id, text, held)."""
    for number, batch in enumerate(batches):
        name = (TaskContext.get().partitionId() << 32) | number
        ids, held = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        hashed = [word_hashes(text) for text in batch.column(1).to_pylist()]
        own, order, often = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
        by = np.argsort(-often, kind="stable")  # small places for frequent words compress better
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        flags = (held * 1 + ids.is_null().to_numpy(zero_copy_only=False) * 2).astype("u1")
        row = {"batch": name, "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "flags": flags.tobytes(),
               "sizes": np.array([len(h) for h in hashed], "<i8").tobytes(), "own": own[by].astype("<u8").tobytes(), "places": pack_order(rank[order])}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("batch", pa.int64()), *[(c, pa.binary()) for c in ("ids", "flags", "sizes", "own", "places")]]))


def _token_row(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flags, numbers of tokens, distinct hashes and places of the tokens of a token row."""
    return np.frombuffer(row["flags"], "u1"), np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["own"], "<u8"), unpack_order(row["places"])


def _keys(bits: int):
    """Token rows to rows of kind w (distinct words) and g (distinct bigrams) by bucket, with their counts in training documents."""
    shift, keep = np.uint64(64 - bits), kept_bits(bits)
    kinds = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flags, sizes, own, order = _token_row(r)
                train, rows = (flags & 1) == 0, []
                word, to = np.unique(own & keep, return_inverse=True)
                within = np.ones(len(order), bool)
                within[np.cumsum(sizes) - 1] = False  # the last token of a document leads no bigram
                pair, place = np.unique(bigram_hashes(own[order])[within[:-1]] & keep, return_inverse=True)
                for kind, key, at_key, n in (("w", word, to[order], sizes), ("g", pair, place, sizes - 1)):
                    count = np.bincount(at_key, np.repeat(train, n), len(key)).astype("<u4")
                    for bucket, at in _by_bucket(key, shift):
                        rows.append({"bucket": bucket, "kind": kind, "batch": r["batch"], "a": pack6(key[at]), "b": count[at].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return keys


def _by_bucket(h: np.ndarray, shift: np.uint64) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes of each bucket, in their order."""
    bucket = (h >> shift).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
    for a, z in zip(first, np.r_[first[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:z]


def _gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of packed rows, their counts over all rows, and the place of each row's keys, row after row."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = unpack6(b"".join(rows["a"]))
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    counts = np.frombuffer(b"".join(rows["b"]), "<u4")[order]
    place = np.empty(len(key), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return key[new], np.add.reduceat(counts, np.flatnonzero(new), dtype=np.int64), place


def _answer(bits: int, size: int):
    """One bucket: exact counts of its words and its segment of the filter, of at least ``size`` bytes; for each batch
    the levels and exact counts of its words (kind s) and the levels of its bigrams (l), in the order of the hashes."""
    shift = 64 - bits
    low = LOW if shift > 48 else np.uint64((1 << shift) - 1)

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(key[0]), []
        rows = rows.sort_values(["kind", "batch"])
        w, g = rows[rows["kind"] == "w"], rows[rows["kind"] == "g"]
        (word, total, word_at), (pair, often, pair_at) = _gathered(w), _gathered(g)
        word, pair, seen, met = word & low, pair & low, total > 0, often > 0
        mine = segment_size(np.concatenate([total[seen], often[met]]), size)
        segment = np.frombuffer(fill_segment(word[seen], total[seen], pair[met], often[met], mine), np.uint8)
        out.append((bucket, "v", -1, np.array([seen.sum(), total.sum()], "<i8").tobytes(), None))
        for kind, sent, keys, place, exact in (("s", w, word, word_at, total), ("l", g, pair, pair_at, None)):
            level, at = probe_levels(keys, segment, shift, mine), 0
            for name, a in zip(sent["batch"], sent["a"]):
                p = place[at : at + len(a) // 6]
                at += len(p)
                out.append((bucket, kind, name, level[p].tobytes(), None if exact is None else exact[p].astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "kind", "batch", "a", "b"])

    return answer


def _assemble(bits: int, total: int):
    """Documents of one batch with sums and scores by the counts and levels that all buckets returned."""

    def assemble(tokens: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows, t = rows.sort_values("bucket"), tokens.iloc[0]
        flag, tokens, own, order = _token_row(t)
        ids = pd.array(np.frombuffer(t["ids"], "<i8"), dtype="Int64")
        ids[(flag & 2) > 0] = pd.NA
        joined = lambda kind, column, of: np.frombuffer(b"".join(rows.loc[rows["kind"] == kind, column]), of)
        keep = kept_bits(bits)
        place = np.unique(own & keep, return_inverse=True)[1]  # buckets in order, hashes in order in each
        exact, first = joined("s", "b", "<i8")[place], np.cumsum(tokens) - tokens
        sums = np.add.reduceat(np.log10(exact + 1.0)[order], first)
        known = np.add.reduceat((exact > 0)[order].astype(np.int64), first)
        score = _score(own[order], first, level_counts()[joined("s", "a", "u1")][place][order], joined("l", "a", "u1"), keep, total)
        return pd.DataFrame({"doc_id": ids, "held_out": (flag & 1) > 0, "n_tokens": tokens, "n_known": known, "sums": sums, "score": score})

    return assemble


def held_out(doc_id):
    return remainder(doc_id, 7) == 2


def lm_scores(docs: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    base_score is the exact add-one unigram score; score the model's log10 probability of the whole text:
    of each token, (1 - s) * unigram + s * bigram, with counts from the filter, s = 0.2, and the text's first token
    and those after an unknown word from the unigrams alone. Null and empty texts are the end token alone. Very long texts count whole.
    Repeated rows count as often as they come. Without training documents every word is unknown and both scores are 0,
    the logarithm of 1 / 1. An empty table gives no rows. What a batch holds is written before anything refers to it, so ``docs``
    may come in another order when a lost task runs again.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 4 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    words = (docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) / 6 + 1
    bits = int(np.ceil(np.log2(max(LEAST_BUCKETS, words / bucket_words))))
    size = max(64, int(max(1 << 16, FILTER_BYTES_PER_WORD * words)) >> bits)
    tokens = written(rows.mapInArrow(_tokenise, TOKENS), "tokens")
    answers = tokens.mapInArrow(_keys(bits), PACKED).groupBy("bucket").applyInPandas(_answer(bits, size), PACKED)
    answers = written(answers, "answers")
    figures = np.sum([np.frombuffer(r["a"], "<i8") for r in answers.where("kind = 'v'").select("a").toLocalIterator()] or [[0, 0]], axis=0)
    vocabulary, total = int(figures[0]), int(figures[1])
    floor = float(np.log10(total + vocabulary + 1))
    out = tokens.groupBy("batch").cogroup(answers.where("kind <> 'v'").groupBy("batch")).applyInPandas(
        _assemble(bits, total + vocabulary + 1), "doc_id long, held_out boolean, n_tokens long, n_known long, sums double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("sums") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")


def _score(h: np.ndarray, first: np.ndarray, count: np.ndarray, pair_levels: np.ndarray, keep: np.uint64, total: int) -> np.ndarray:
    """log10 probabilities of the texts that start at ``first``, from their tokens' hashes and counts and the levels of
    their distinct pairs in the order of the kept hashes."""
    p = (count + 1.0) / total
    inner = np.ones(len(h), dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = level_counts()[pair_levels][np.unique(bigram_hashes(h)[at - 1] & keep, return_inverse=True)[1]]
    before = count[at - 1]
    follow = pair / np.maximum(np.maximum(before, pair), 1.0)
    share = np.where(before > 0, BIGRAM_SHARE, 0.0)  # an unknown word tells nothing about the next
    p[at] = (1 - share) * p[at] + share * follow
    return np.add.reduceat(np.log10(p), first)
