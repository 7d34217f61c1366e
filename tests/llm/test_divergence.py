import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import divergence
from tests.llm.fixtures import hard_docs, hard_rows, no_docs, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(rows, least=3, top=200):
    """The contract in plain Python over (text, lang, source)."""
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        n[lang, source].update(words(text))
        df[lang].update(set(words(text)))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        total = Counter()
        for s in sources:
            total.update({t: n[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def result(df, **kw):
    return sorted(tuple(r) for r in divergence.divergence_audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_pointer_sort_of_hard_words():
    rng = random.Random(2)
    made = [bytes(rng.choice(b"abz\xc3\xa9") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(300)]
    made += [b"a" * k for k in (7, 8, 9, 64, 65, 72, 500)] * 3 + [b"a" * 500 + b"b"] * 2
    rng.shuffle(made)
    data = np.frombuffer(b" ".join(made), np.uint8)
    length = np.array([len(w) for w in made])
    start = np.cumsum(length + 1) - length - 1
    order, first = divergence.pointer_sort(data, start, length)
    want = sorted(range(len(made)), key=lambda i: made[i])  # stable
    assert list(order) == want
    assert list(first) == [i == 0 or made[want[i]] != made[want[i - 1]] for i in range(len(made))]


def test_count_shard_breaks_words_at_texts():
    texts = ["ab AB", "ab", "", "Cé1é", "ab", "x-y"]
    group = np.array([1, 0, 0, 1, 1, 0])
    for kind in (pa.string(), pa.large_string()):
        term, g, n, d = divergence.count_shard(group, pa.array(["junk"] + texts, kind).slice(1))
        assert sorted(zip(term.to_pylist(), g, n, d)) == [("ab", 0, 1, 1), ("ab", 1, 3, 2), ("cé", 1, 1, 1), ("x", 0, 1, 1), ("y", 0, 1, 1), ("é", 1, 1, 1)]


@pytest.mark.parametrize("settings", [dict(), dict(least_docs=1, block_postings=7, top=3)])
def test_audit_against_plain_python(spark, monkeypatch, settings):
    rows = [(prose(i, 40, "abÉ"), ["en", "fr", None][i % 3], [None, "a", "b", "c", "é"][i % 5 if i % 7 else 1]) for i in range(90)]
    rows += [("", "xx", "only"), (None, "yy", "a"), ("q", "yy", "b"), ("", "yy", "")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    want = expected(rows, settings.get("least_docs", 3), settings.get("top", 200))
    assert result(df, **settings) == want
    monkeypatch.setattr(divergence, "PAIRS", 6)  # slabs of one or two sources
    assert result(df, **settings) == want


def test_hard_rows_and_none(spark):
    assert result(hard_docs(spark)) == expected([(r[1], r[2], r[3]) for r in hard_rows()])
    assert result(no_docs(spark)) == []


def test_shards_of_any_size_count_alike(spark):
    a = sorted(tuple(r) for r in divergence.term_counts(hard_docs(spark), 1).collect())
    b = sorted(tuple(r) for r in divergence.term_counts(hard_docs(spark)).collect())
    assert a == b and len(a) > 100


def test_shares_are_exact_for_large_counts():
    for count, total in [(10**12, 3 * 10**12 + 7), (0, 1), (5, 6), (10**14, 10**14 + 1)]:
        assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total
