"""Unit tests of the semantic hazards on tiny literal frames."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import exprs as X


def one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_np_round_is_half_even_on_binary(spark):
    vals = [0.125, 0.135, 2.675, 1.005, -0.125, 12.345, 0.5, 1.5, 2.5]
    got = one(spark, X.np_round("x", 2), [(v,) for v in vals], "x double")
    assert got == [float(np.round(v, 2)) for v in vals]
    got0 = one(spark, X.np_round("x", 0), [(v,) for v in vals], "x double")
    assert got0 == [float(np.round(v, 0)) for v in vals]


def test_title_case_matches_python(spark):
    words = ["johnson-davis", " O'NEIL AND SONS ", "mcdonald's", "1abc", "x--y", "ÉCOLE d'été", "", "ß straße",
             "HELLO_world", "a\tb"]
    got = one(spark, X.title_case("s"), [(w,) for w in words], "s string")
    assert got == [w.title() for w in words]
    assert one(spark, X.title_case("s"), [(None,)], "s string") == [None]


def test_py_strip_removes_tabs_and_newlines(spark):
    words = ["  a b  ", "\tx\n", "\r\n y \x0b", "none"]
    assert one(spark, X.py_strip("s"), [(w,) for w in words], "s string") == [w.strip() for w in words]


def test_parse_date_three_formats_and_garbage(spark):
    got = one(spark, X.parse_date("s", ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy")),
              [("2024-01-15",), ("01/15/2024",), ("15-01-2024",), ("not-a-date",), ("13/45/2024",), (None,)],
              "s string")
    d = dt.date(2024, 1, 15)
    assert got == [d, d, d, None, None, None]


def test_parse_date_single_format_reproduces_the_observed_loss(spark):
    got = one(spark, X.parse_date("s", ("yyyy-MM-dd",)), [("2024-01-15",), ("01/15/2024",), ("15-01-2024",)], "s string")
    assert got == [dt.date(2024, 1, 15), None, None]


def test_nan_is_missing(spark):
    got = one(spark, X.nan_to_null("x"), [(float("nan"),), (1.0,), (None,)], "x double")
    assert got == [None, 1.0, None]


def test_all_true_pandas_semantics(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert df.agg(X.all_true(F.col("x") >= 0)).first()[0] is False          # null compares False
    empty = spark.createDataFrame([], "x double")
    assert empty.agg(X.all_true(F.col("x") >= 0)).first()[0] is True         # empty is True


def test_rate_pct_zero_denominator_is_null(spark):
    got = one(spark, X.rate_pct("a", "b"), [(1, 0), (1, 3), (2, 3)], "a long, b long")
    assert got == [None, float(np.round(1 / 3 * 100, 2)), float(np.round(2 / 3 * 100, 2))]


def test_row_hash_has_no_separator_and_renders_missing_as_nan(spark):
    import hashlib
    rows = [("INV-1", 1234.5, "2024-01-15"), ("INV-1", None, "2024-01-15"), ("INV-2", 12345678.0, "2024-01-15")]
    got = one(spark, X.row_hash("i", "a", "d"), rows, "i string, a double, d string")
    assert got[0] == hashlib.md5(b"INV-11234.52024-01-15").hexdigest()
    assert got[1] == hashlib.md5(b"INV-1nan2024-01-15").hexdigest()
    assert got[2] == hashlib.md5(b"INV-212345678.02024-01-15").hexdigest()


def test_money_text_matches_python_str_beyond_1e7(spark):
    vals = [12345678.5, 10000000.0, 0.0, 1234.56, 99.1, 280123456.78]
    got = one(spark, X.money_text("x"), [(v,) for v in vals], "x double")
    assert got == [str(v) for v in vals]


def test_with_scalars_plans_no_cartesian_product(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2.0)
    stats = df.agg(F.avg("x").alias("mu"))
    plan = X.with_scalars(df, stats)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert X.with_scalars(df, stats).count() == 100


def test_py_float_text_matches_python_repr(spark):
    import random
    rnd = random.Random(7)
    vals = [9.799970600088199e-05, -0.000818997543007371, 1e-05, 0.0001, 0.0005, 12345678.5, 1e7, 1e15,
            -3.2e-300, 0.0, 123.456, float("nan"), float("inf")]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 15) for _ in range(500)]
    got = one(spark, X.py_float_text("x"), [(v,) for v in vals], "x double")
    assert got == [repr(v) for v in vals]
