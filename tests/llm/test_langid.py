import math
import random

import numpy as np

from quillspark.llm import langid
from tests.llm.fixtures import hard_docs, hard_rows, no_docs, prose


def greedy(text, sample):
    """Phrases of the greedy parse into substrings of the sample; an unknown letter ends a phrase."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        end = max(at, end - 1)
        if end == at and end < len(text):  # an unknown letter: part of no phrase, and it ends the one before
            end += 1
        n += 1
        at = end
    return n


def test_phrases_against_substring_search():
    rng = random.Random(4)
    for _ in range(60):
        sample = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        codes = {c: i for i, c in enumerate("abc ")}
        if not set(text) <= set(sample):
            continue
        table = langid.parse_table([codes[c] for c in sample], 4)
        symbols = np.array([codes[c] for c in text], dtype=np.uint8)
        got = langid.phrase_counts(symbols, np.array([0]), np.array([len(text)]), table, 4)
        assert got.tolist() == [greedy(text, sample)]


def test_many_blocks_at_once_are_as_each_alone():
    rng = np.random.default_rng(1)
    table = langid.parse_table(rng.integers(0, 3, 100).tolist(), 4)
    symbols = rng.integers(0, 4, 500).astype(np.uint8)
    starts, lengths = np.array([0, 7, 100, 250]), np.array([7, 93, 150, 250])
    both = langid.phrase_counts(symbols, starts, lengths, table, 4)
    assert both.tolist() == [langid.phrase_counts(symbols, np.array([s]), np.array([n]), table, 4)[0] for s, n in zip(starts, lengths)]


def test_score_follows_the_bits():
    model = langid.fit({"x": [prose(1, 400, "abcde")], "y": [prose(2, 400, "vwxyz")]})
    langs, score, bits = langid.score_texts(["abcde bad", "wxyz", None, "", "12 !", "abc vwx"], model)
    assert langs[:2] == ["x", "y"] and langs[2:5] == ["und"] * 3 and score[2:5] == [0.0] * 3
    assert all(0 <= s <= 1 for s in score) and score[0] > 0.9 > 0.5
    assert all(math.isfinite(b) for b in bits)


def test_held_out_accuracy(spark):
    rows = [(i, prose(1000 + i, 40, "aeioulmnr" if i % 2 else "kgztwuoe"), "en" if i % 2 else "de") for i in range(400)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50
    assert sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in held) >= 0.98 * len(held)


def test_hard_documents(spark):
    rows = langid.language_id(hard_docs(spark)).collect()
    assert len(rows) == len(hard_rows())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for doc in (5, 6, 7, 8):  # null, empty, white space, no letters
        assert by[doc]["lang_pred"] == "und" and by[doc]["score"] == 0
    assert all(r["lang_pred"] in ("und", "en", "fr") and 0 <= r["score"] <= 1 for r in rows)


def test_filter_keeps_rows_whole(spark):
    docs = hard_docs(spark)
    kept = langid.keep_identified(docs, 8.0)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {5, 6, 7, 8} & set(ids) and ids.count(1) == 2


def test_nothing_to_learn_from(spark):
    docs = hard_docs(spark)
    assert langid.language_id(no_docs(spark)).collect() == []
    none = docs.withColumn("lang", docs["lang"].substr(1, 0)).replace("", None, ["lang"])
    assert {r["lang_pred"] for r in langid.language_id(none).collect()} == {"und"}


def test_copies_and_long_texts_do_not_empty_the_sample(spark):
    """A language keeps its whole share of the sample beside a group of copies, or one text far beyond the share."""
    rows = [("aa", prose(i, 20)) for i in range(200)] + [("aa", prose(900, 40))] * 4000
    rows += [("bb", prose(300 + i, 20)) for i in range(30)] + [("bb", prose(901, 60_000))]
    got = langid.sample_texts(spark.createDataFrame(rows, "lang string, text string"), 4000, 3000)
    assert {lang: sum(map(len, texts)) for lang, texts in got.items()} == {"aa": 2000, "bb": 2000}
    assert len(set(got["aa"])) == len(got["aa"]) > 10


def test_languages_of_large_scripts_stay_apart():
    """Two languages over disjoint halves of 3,000 ideographs, and a Latin one: no letter is lost to a cap on classes."""
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(3000)]
    write = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": [write(han[:1500], 6000)], "b": [write(han[1500:], 6000)], "en": [prose(1, 2000)]}
    model = langid.fit(samples)
    assert model.width <= 250 and model.ranks is not None
    texts = [write(han[:1500], 60) for _ in range(20)] + [write(han[1500:], 60) for _ in range(20)] + [prose(i, 20) for i in range(20)]
    langs, scores, _ = langid.score_texts(texts, model)
    assert langs == ["a"] * 20 + ["b"] * 20 + ["en"] * 20 and min(scores) > 0.5


def test_spelled_letters_are_distinct():
    letters = [chr(i) for i in range(0x4E00, 0x4E00 + 5000)] + list("abc")
    classes, ranks, width = langid.letter_classes(["".join(letters)])
    spelled = {tuple(langid.classify(c, classes, ranks)) for c in letters}
    assert len(spelled) == len(letters) and max(max(s) for s in spelled) < width <= 250
    assert langid.classify("a" + letters[4000] + "  b", classes, ranks).tolist() == [
        *langid.classify("a", classes, ranks), *langid.classify(letters[4000], classes, ranks), langid.GAP, *langid.classify("b", classes, ranks)]
