import random

from quillspark.llm import quality
from tests.llm.fixtures import hard_docs, hard_rows, no_docs, prose


def junk(seed):
    rng = random.Random(seed)
    kind, words = rng.randint(0, 2), prose(seed, 60).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w for w in words[:6] for _ in range(10))
    return " | ".join(words)


def corpus(spark, n=500):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(n)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    held = [r for r in quality.quality_scores(docs, labels).collect() if r["held_out"]]
    assert len(held) > 60
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)


def test_votes_against_plain_loop():
    import numpy as np

    rng = np.random.default_rng(0)
    v = quality.unit(rng.standard_normal((40, 5)))
    model = {"vectors": v, "labels": rng.integers(0, 2, 40).astype(float)}
    z = quality.unit(rng.standard_normal((9, 5)))
    for row, got in zip(z, quality.vote(z, model, 7)):
        near = sorted(((float(row @ x), y) for x, y in zip(v, model["labels"])), reverse=True)[:7]
        w = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        assert abs(got - sum(a * y for a, (_, y) in zip(w, near)) / sum(w)) < 1e-9


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = corpus(spark, 200)
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.held_out(labels), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, quality.quality_scores(docs, labels).collect()))
    assert a == sorted(map(tuple, quality.quality_scores(docs, other).collect()))


def test_hard_documents(spark):
    docs, labels = corpus(spark, 120)
    labels = labels.union(spark.createDataFrame([(None, 1), (5, None), (1, 7), (2, 0), (2, 0)], labels.schema))
    mixed = hard_docs(spark).select("doc_id", "text").union(docs.selectExpr("doc_id + 1000", "text"))
    rows = quality.quality_scores(mixed, labels.selectExpr("doc_id + 1000 as doc_id", "quality")).collect()
    assert len(rows) == len(hard_rows()) + 120
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (5, 6)} == {0.0}


def test_filter_keeps_rows_whole(spark):
    docs, labels = corpus(spark, 120)
    hard = hard_docs(spark)
    learn = docs.selectExpr("doc_id + 1000 as doc_id", "text", *[f"cast(null as {t}) {c}" for c, t in hard.dtypes[2:]])
    kept = quality.keep_good(hard.union(learn), labels.selectExpr("doc_id + 1000 as doc_id", "quality"))
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {5, 6} & set(ids) and ids.count(1) == 2


def test_foreign_labels_copies_and_empty_texts_take_no_place_in_the_sample(spark):
    docs, labels = corpus(spark, 300)
    alone = quality.labelled_sample(docs, labels, 50)
    assert [q for _, _, q in alone] == [0] * 50 + [1] * 50
    foreign = spark.range(10_000, 3_010_000).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    more = spark.range(20_000, 24_000).selectExpr("id doc_id", "if(id % 2 = 0, 'the same text', '') text")
    full = quality.labelled_sample(docs.union(more), labels.union(foreign), 50)
    assert [q for _, _, q in full] == [0] * 50 + [1] * 50
    bag = lambda s: (s[2], tuple(s[0]), tuple(s[1]))
    assert len(set(map(bag, full)) - set(map(bag, quality.labelled_sample(docs, labels, 300)))) <= 2  # the one text that was added


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 20)
    assert quality.quality_scores(no_docs(spark), labels).collect() == []
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.0}
