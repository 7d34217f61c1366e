import math
import zlib
from collections import Counter

import numpy as np

from quillspark.llm import lm
from tests.llm.fixtures import WORD, hard_docs, hard_rows, no_docs, prose


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def check_exact(rows, got):
    """Exact columns of all documents against counts in a dictionary."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                   sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows)
    mine = sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:6]) for r in got)
    assert [w[:5] for w in want] == [m[:5] for m in mine]
    assert np.allclose([w[5] for w in want], [m[5] for m in mine], rtol=1e-9, atol=1e-9)


def test_hard_documents(spark):
    got = lm.lm_scores(hard_docs(spark)).collect()
    check_exact([(d, t) for d, t, *_ in hard_rows()], got)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_many_batches_and_buckets(spark):
    rows = [(i, prose(i % 150, 30 + i % 50)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    got = lm.lm_scores(docs, bucket_words=50).collect()
    check_exact(rows, got)
    # texts that come twice are known better than by their words alone
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_no_documents_and_no_training_documents(spark):
    assert lm.lm_scores(no_docs(spark)).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.lm_scores(spark.createDataFrame([(alone, "a b c")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 4, 0, 0, 0.0, 0.0)


def keys(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 57, n).astype(np.uint64)


def test_filter_gives_counts_back():
    words, counts = keys(3000, 1), np.random.default_rng(2).integers(1, 5000, 3000)
    size = 1 << 18
    filter_ = np.frombuffer(lm.fill_segment(words, counts, keys(0, 0), counts[:0], size), np.uint8)
    got = lm.probe(words, filter_, 58, size)
    assert np.median(np.abs(got / counts - 1)) < 0.1 and (got >= 0.85 * counts).all()
    assert (lm.probe(keys(20000, 9), filter_, 58, size) > 0).mean() < 0.02


def test_buckets_are_even(spark):
    """Token rows stay out of the buckets, and keys spread by hash: however many batches there are, no bucket holds twice the median."""
    rows = [(i, " ".join(np.base_repr(j * 7919 + i, 36) for j in range(400))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12).selectExpr("doc_id", "text", "false held")
    keys_ = docs.mapInArrow(lm._tokenise, lm.TOKENS).mapInArrow(lm._keys(6), lm.PACKED)
    sizes = sorted(r[1] for r in keys_.groupBy("bucket").agg({"a": "count"}).collect())
    held = sorted(r["n"] for r in keys_.selectExpr("bucket", "octet_length(a) n").groupBy("bucket").sum("n").withColumnRenamed("sum(n)", "n").collect())
    assert len(held) == 64 and sizes[-1] == 24 and held[-1] < 2 * held[32]


def test_scores_against_counts_in_a_dictionary(spark):
    """The score's formula with exact counts of words and bigrams; the filter's counts are levels within ten percent."""
    rows = [(i, prose(i % 90, 20 + i % 60)) for i in range(300)] + [(1000, prose(999, 40, "xyzw")), (1001, None), (1002, "one")]
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    train = [tokens(t) for d, t in rows if not got[d]["held_out"]]
    words, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))
    total = sum(words.values()) + len(words) + 1
    for d, text in rows:
        t = tokens(text)
        want = math.log10((words[t[0]] + 1) / total)
        for before, word in zip(t, t[1:]):
            share = lm.BIGRAM_SHARE if words[before] else 0.0
            want += math.log10((1 - share) * (words[word] + 1) / total + share * pairs[before, word] / max(words[before], 1))
        assert abs(got[d]["score"] - want) <= 0.05 * len(t), (d, got[d]["score"], want)


def test_no_key_is_left_out_however_many_there_are(spark):
    """More keys than the filter's least size takes: every word and pair, also those seen once, has its count in the scores."""
    rows = [(i, " ".join(np.base_repr(36**3 + i * 3000 + (k * 7) % 3000, 36) for k in range(3000))) for i in range(40)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    train = [r for r in got if not r["held_out"]]
    n = train[0]["train_tokens"]
    assert n == 3001 * len(train)
    total, ends = n + 3000 * len(train) + 1 + 1, len(train)
    p = math.log10(2 / total) + 2999 * math.log10(0.8 * 2 / total + 0.2) + math.log10(0.8 * (ends + 1) / total + 0.2)
    assert all(abs(r["score"] / p - 1) < 0.1 for r in train)
