"""Sparse one-hot vectors of any number of categories."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import features


def test_a_hundred_thousand_categories_without_the_driver(spark, monkeypatch):
    n = 100_000
    df = spark.range(3 * n).selectExpr("id", f"concat('c', lpad(cast(id * 7 % {n} as string), 6, '0')) AS category").repartition(5)
    with monkeypatch.context() as m:
        for action in ("collect", "toPandas", "first", "take", "toLocalIterator"):
            m.setattr(DataFrame, action, lambda *a, **k: pytest.fail("rows on the driver"))
        codes = features.category_codes(df)
        vec = features.sparse_onehot(df, codes)
    assert codes.where(F.col("code") != F.expr("cast(substring(category, 2) as bigint)")).count() == 0
    assert codes.agg(F.count("*"), F.countDistinct("code"), F.min("code"), F.max("code")).first() == (n, n, 0, n - 1)
    assert vec.where("category_vec.size = 100000 AND category_vec.indices[0] = cast(substring(category, 2) as bigint) "
                     "AND category_vec.values = array(1.0D)").count() == 3 * n
    with pytest.raises(ValueError):
        features.observed_categories(df)


def test_nulls_unknown_values_repeats_and_odd_names(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, ""), (6, "zz")], "code int, `kind of` string")
    codes = features.category_codes(df.where("code < 6"), "kind of")
    assert {tuple(r) for r in codes.collect()} == {("", 0), ("a", 1), ("b", 2)}
    got = {r["code"]: (r.vec.size, r.vec["indices"], r.vec["values"]) for r in features.sparse_onehot(df, codes, "kind of", "vec").collect()}
    assert got == {1: (3, [2], [1.0]), 2: (3, [], []), 3: (3, [1], [1.0]), 4: (3, [2], [1.0]), 5: (3, [0], [1.0]), 6: (3, [], [])}


def test_no_rows(spark):
    df = spark.createDataFrame([], "id int, category string")
    codes = features.category_codes(df)
    assert codes.count() == 0 and features.sparse_onehot(df, codes).count() == 0
    some = spark.createDataFrame([(1, None)], "id int, category string")
    assert features.sparse_onehot(some, features.category_codes(some)).first().category_vec == (0, [], [])


def test_a_column_of_the_same_name_as_the_code(spark):
    df = spark.createDataFrame([("x", 9)], "category string, size int")
    row = features.sparse_onehot(df, features.category_codes(df)).first()
    assert (row["size"], row.category_vec) == (9, (1, [0], [1.0]))
