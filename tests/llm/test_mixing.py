from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing
from tests.llm.fixtures import WORD, hard_docs, hard_rows, no_docs, prose


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]).tolist() == [50, 100, 150]
    t = mixing.targets([10, 1000, 10], [1, 2, 3])
    assert t[2] == 30 and t[0] == 30 and abs(t.sum() - 1020) < 1e-9
    assert mixing.targets([0, 0], [1, 2]).tolist() == [0, 0] and len(mixing.targets([], [])) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(got) == list(range(n))
    if n > 16:
        assert got.tolist() != mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 100)).tolist() != list(range(n))


def test_shards_split_the_slots_of_each_source():
    slots = np.array([70, 0, 400, 31])
    first = np.zeros(4, dtype=np.int64)
    for shard in range(6):
        at, count = mixing.shard_counts(shard, 6, slots, 100, 1)
        assert (at == first).all() and count.sum() == (100 if shard < 5 else 1)
        first = first + count
    assert (first == slots).all()


def corpus(spark):
    rows = [(i, prose(i, 5 + i % 90), ["a", "b", "c", None][0 if i % 3 else i % 4]) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_report(spark):
    rows, docs = corpus(spark)
    got = mixing.mix_report(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()))
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    of = {d: s for d, _, s in rows}
    total, taken, target = Counter(), Counter(), {}
    for d, n in size.items():
        total[of[d]] += n
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[of[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - sum(total.values())) < 1e-6
    for s in total:
        assert target[s] <= 3 * total[s] + 1e-9 and abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS


def test_blocks_hold_the_stream_of_each_source(spark):
    rows, docs = corpus(spark)
    m = mixing.mix(docs.select("doc_id", "source", mixing.words("text").alias("size")), "row", "size")
    parts = m.blocks.collect()
    slots = {(r["shard"], r["slot"]) for r in parts}
    assert len(slots) == m.plan.slots.sum()
    words, whole = defaultdict(int), {(s, b): min(mixing.BLOCK_WORDS, int(m.plan.size[s]) - b * mixing.BLOCK_WORDS)
                                      for s in range(len(m.plan.names)) for b in range(m.plan.blocks[s])}
    for r in parts:
        words[r["shard"], r["slot"], r["src"], r["block"], r["pass"]] += r["n"]
    for (_, _, s, b, _), n in words.items():
        assert n == whole[s, b]
    assert max(Counter((s, b, p) for _, _, s, b, p in words).values()) == 1  # a pass takes a block once


def test_mixed_documents(spark):
    rows, docs = corpus(spark)
    docs = docs.withColumn("n_chars", F.length("text")).withColumn("pass", F.lit("x")).withColumn("src", F.lit("y"))
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    text, words = {d: t for d, t, _ in rows}, Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and all(part in text[r["doc_id"]] for part in r["text"].split("\n"))
    assert {d: n for d, n in report.items() if n} == dict(words)


def test_hard_documents(spark):
    got = mixing.mix_report(hard_docs(spark)).collect()
    assert len(got) == len(hard_rows())
    want = Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in hard_rows())
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    assert mixing.mixed_documents(hard_docs(spark)).columns == hard_docs(spark).columns
    assert mixing.mixed_documents(hard_docs(spark)).count() > 0


def test_no_documents(spark):
    assert mixing.mix_report(no_docs(spark)).collect() == []
    assert mixing.mixed_documents(no_docs(spark)).collect() == []
