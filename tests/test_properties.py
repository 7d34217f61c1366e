"""Property tests: parity helpers against Python / numpy on random inputs (one Spark job per property)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.functions import exprs as X
from quillspark.operators import documents

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ-'. _1\tÉéß")), max_size=20)


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=60))
def test_title_case_property(spark, words):
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "s string").select(X.title_case("s")).collect()]
    assert got == [w.title() for w in words]


@SETTINGS
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=1, max_size=60),
       st.integers(min_value=0, max_value=4))
def test_np_round_property(spark, vals, n):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(X.np_round("x", n)).collect()]
    assert got == [float(np.round(v, n)) for v in vals]


@SETTINGS
@given(st.lists(st.floats(min_value=-1e15, max_value=1e15, allow_nan=False, allow_infinity=False), min_size=1, max_size=60))
def test_py_float_text_property(spark, vals):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(X.py_float_text("x")).collect()]
    assert got == [repr(v) for v in vals]


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=9000), min_size=1, max_size=12))
def test_chunks_cover_text_property(spark, lengths):
    texts = ["".join(chr(97 + (i * 7 + j) % 26) for j in range(n)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = documents.chunk_documents(df).select("doc_id", "chunk_idx", "chunk_text").collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_idx)):
        by_doc.setdefault(r.doc_id, []).append(r.chunk_text)
    for i, t in enumerate(texts):
        parts = by_doc.get(i, [])
        assert (parts[0] + "".join(p[200:] for p in parts[1:]) if parts else "") == t
        assert all(len(p) <= 2000 for p in parts)
