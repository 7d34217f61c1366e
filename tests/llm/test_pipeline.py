"""The stages one after the other on a table with the hard cases; each against what its operator is tested for."""

import corpus_pipeline
from quillspark.llm import langid, mixing, packing, quality, simhash
from quillspark.llm.common import table
from tests.conftest import SF_SMALL


def test_stages(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_classifier", "language_id", "near_duplicates", "source_mix", "packed_sequences"]
    docs = table(spark, SF_SMALL, "documents")
    labels = table(spark, SF_SMALL, "labels")
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["predicted"]}
    step = corpus_pipeline.quality_classifier(spark, docs, SF_SMALL).cache()
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == good
    known = {r["doc_id"] for r in langid.language_id(step).collect() if r["lang_pred"] != "und" and r["bits"] <= corpus_pipeline.MAX_BITS}
    step = corpus_pipeline.language_id(spark, step, SF_SMALL).cache()
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == known
    first = {r["component_id"] for r in simhash.near_duplicates(step).collect()}
    step = corpus_pipeline.near_duplicates(spark, step, SF_SMALL).cache()
    assert step.columns == docs.columns and sorted(r["doc_id"] for r in step.collect()) == sorted(first)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(step).collect() if r["taken"]}
    step = corpus_pipeline.source_mix(spark, step, SF_SMALL).cache()
    assert step.columns == docs.columns
    words = step.groupBy("doc_id").agg({"n_chars": "sum"}).count()
    assert words == len(taken)
    last = corpus_pipeline.packed_sequences(spark, step, SF_SMALL).collect()
    assert len({(r["doc_id"]) for r in last}) == len(taken)
    fill = {}
    for r in last:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= packing.Capacity().tokens
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(tuple(r)[:5] for r in last)


def test_every_operator_is_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
