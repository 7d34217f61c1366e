import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import simhash
from quillspark.llm.common import connected_components
from tests.llm.fixtures import WORD, hard_docs, hard_rows, no_docs


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=3):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbBéÉ \t\n\x0b\x1c .")))
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == slow_fingerprint(text)


def test_hard_documents(spark):
    rows = simhash.near_duplicates(hard_docs(spark)).collect()
    want = [(d, slow_fingerprint(t)) for d, t, *_ in hard_rows()]
    label = slow_components([f for _, f in want])
    least = {k: min((d for (d, _), at in zip(want, label) if at == k and d is not None), default=None) for k in set(label)}
    expected = [(d, format(f, "016x"), least[k]) for (d, f), k in zip(want, label)]
    order = lambda x: tuple((v is None, v or 0) for v in (x[0], x[2])) + (x[1],)
    assert sorted(map(tuple, rows), key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("heavy", [4096, 3])
def test_links_against_all_pairs(spark, heavy, monkeypatch):
    """Clusters whose members share halves, chains of three-bit steps, lone fingerprints; also with heavy halves."""
    monkeypatch.setattr(simhash, "HEAVY_HALF", heavy)
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        center = rng.getrandbits(64)
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(15)}
        fps |= {center ^ sum(1 << b for b in rng.sample(range(32), 2)) for _ in range(15)}
        chain = rng.getrandbits(64)
        for _ in range(10):
            chain ^= sum(1 << b for b in rng.sample(range(64), 3))
            fps.add(chain)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4))
    root = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    mine, label = [root.get(f, f) for f in signed], slow_components(fps)
    assert len(set(zip(mine, label))) == len(set(mine)) == len(set(label))
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 64 for r in links.collect())


def test_a_large_group_returns_fewer_links_than_members(spark):
    near = [(1 << a) | (1 << b) for a in range(40) for b in range(a)]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in near], "fp long")).count()
    assert links < 34 * len(near)


def test_keep_one(spark):
    docs = hard_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(r["component_id"], r["fingerprint"] if r["component_id"] is None else "") for r in simhash.near_duplicates(docs).collect()}
    rows = kept.collect()
    assert len(rows) == len(want)
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {c for c, _ in want if c is not None}


def test_no_documents(spark):
    assert simhash.near_duplicates(no_docs(spark)).collect() == []
    assert simhash.keep_one(no_docs(spark)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (5, 300)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100), (300, 0)} | {x for x in got if x[0] == x[1]}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []
