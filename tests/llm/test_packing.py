import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import packing, tokens
from quillspark.llm.packing import Capacity, best_fit
from quillspark.llm.queries import tokenizer_path
from tests.llm.fixtures import hard_docs, hard_rows, no_docs


@pytest.fixture(scope="module")
def words():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return tokens._Words(f.read(), 1000)


def ids(words, text):
    return np.frombuffer(words.whole(text), "<u4").tolist()


def by_word(words, text):
    return words.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA éÉß'st<|>́  \x1c\n12"))))
def test_ids_word_by_word_are_those_of_the_whole_text(words, text):
    assert by_word(words, text) == words.whole(text)


def test_ids_of_special_strings(words):
    for text in ("a<|endoftext|>b", "<|startoftext|>", "I'll don't 'S", "Ω ΑΣ ΣΑΣ", "İstanbul", "é é", "x" * 5000):
        assert by_word(words, text) == words.whole(text)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_limit(rule):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    cap = Capacity(tokens=100, documents=4, attention=6000)
    seq, offset = best_fit(lengths, cap, rule)
    for s in range(seq.max() + 1):
        mine = lengths[seq == s]
        assert mine.sum() <= 100 and len(mine) <= 4
        assert (mine.astype(float) ** 2).sum() <= 6000 or len(mine) == 1
        assert sorted(offset[seq == s]) == sorted(np.cumsum(mine) - mine)


def test_best_fit_takes_the_tightest_sequence():
    seq, _ = best_fit(np.array([60, 50, 45, 40]), Capacity(tokens=100))
    assert seq.tolist() == [0, 1, 1, 0]


def test_best_fit_needs_few_sequences():
    random.seed(5)
    lengths = np.sort([random.randint(1, 2048) for _ in range(1500)])[::-1]
    seq, _ = best_fit(lengths, Capacity())
    assert seq.max() + 1 <= 1.02 * lengths.sum() / 2048 + 1


def test_hard_documents(spark, words):
    rows = packing.pack_documents(hard_docs(spark), tokenizer_path(), shard_pieces=8).collect()
    left = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    want = []
    for doc, text, *_ in hard_rows():
        all_ids = ids(words, text or "") + [0]
        for at in range(0, len(all_ids), 2048):
            part = all_ids[at : at + 2048]
            want.append((doc, at // 2048, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(left, key=order) == sorted(want, key=order)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_no_documents(spark):
    assert packing.pack_documents(no_docs(spark), tokenizer_path()).collect() == []
