from collections import Counter

from tokenizers import Tokenizer

from quillspark.llm import token_counts
from quillspark.llm.queries import tokenizer_path
from tests.llm.fixtures import hard_docs, hard_rows, no_docs


def test_against_brute_force(spark):
    t = Tokenizer.from_file(tokenizer_path())
    lengths = [len(t.encode(text or "", add_special_tokens=False).ids) for _, text, *_ in hard_rows()]
    table = token_counts.token_counts(hard_docs(spark), tokenizer_path())
    rows = {r["length"]: r for r in table.collect()}
    assert {n: r["n_docs"] for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r["docs_up_to"] == sum(x <= n for x in lengths) and r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_up_to"] == sum(x for x in lengths if x <= n) and r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["quantile"] - r["docs_up_to"] / len(lengths)) < 1e-12
    for limit in (0, 1, 5, 100, 10**6):
        assert token_counts.truncated_at(table, limit).first()[0] == sum(min(x, limit) for x in lengths)


def test_no_documents(spark):
    table = token_counts.token_counts(no_docs(spark), tokenizer_path())
    assert table.collect() == []
    assert token_counts.truncated_at(table, 10).first()[0] == 0
