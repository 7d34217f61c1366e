"""Moments that do not depend on partitioning: equal bits, right values, hard cases."""

import math
import struct

import numpy as np
import pandas as pd
import pytest

from quillspark.functions.moments import exact_moments, limbs_sql
from quillspark.operators import features


def bits(row) -> list[bytes]:
    return [struct.pack("<d", v) if v is not None else b"" for v in row]


def want(values, ddof=0):
    n = len(values)
    mean = math.fsum(values) / n
    return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (n - ddof))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.lognormal(8, 3, n), "b": rng.normal(0, 1e-7, n), "c": 1e8 + rng.normal(0, 1, n),
                        "d": np.where(np.arange(n) == 77, 1e9, rng.normal(0, 1, n)), "e": rng.integers(0, 2, n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_moments_are_bit_equal_for_1_7_and_64_partitions(table):
    pdf, df = table
    cols = ["a", "b", "c", "d", "e"]
    got = [exact_moments(x, cols, ddof=1).first() for x in (df.coalesce(1), df.repartition(7), df.repartition(64, "id"), df.orderBy("b").repartition(64))]
    assert len({tuple(bits(r)) for r in got}) == 1
    for c in cols:
        mean, std = want(pdf[c].tolist(), 1)
        assert got[0][f"__mu_{c}"] == pytest.approx(mean, rel=1e-14, abs=1e-16 * pdf[c].abs().max())
        assert got[0][f"__sd_{c}"] == pytest.approx(std, rel=1e-13)


def test_scaler_and_zscore_are_bit_equal(spark, table):
    _, df = table
    cols = ["a", "b", "c", "d", "e"]
    scaled = [features.standard_scale(x, cols).orderBy("id").collect() for x in (df.coalesce(1), df.repartition(7), df.repartition(64))]
    assert [bits(r[1:]) for r in scaled[0]] == [bits(r[1:]) for r in scaled[1]] == [bits(r[1:]) for r in scaled[2]]


def test_nulls_empty_single_and_not_finite(spark):
    df = spark.createDataFrame([(1.0, None, 2.5, float("nan"), float("inf"), 1e308, 5e-324),
                                (3.0, None, None, 1.0, 1.0, -1e308, 1e-320)], "a double, b double, c double, d double, e double, f double, g double")
    r = exact_moments(df, df.columns, ddof=1).first()
    assert (r["__mu_a"], r["__sd_a"]) == (2.0, math.sqrt(2.0))
    assert (r["__mu_b"], r["__sd_b"], r["__mu_c"], r["__sd_c"]) == (None, None, 2.5, None)
    assert all(math.isnan(r[f"__{m}_{c}"]) for m in ("mu", "sd") for c in "de")
    assert r["__mu_f"] == 0.0 and r["__sd_f"] == pytest.approx(1e308 * math.sqrt(2))
    assert r["__mu_g"] == 0.0  # below 2^-80 of the least scale
    empty = exact_moments(df.limit(0), ["a"]).first()
    assert tuple(empty) == (None, None)


def test_clashing_and_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0)], "`x0` double, `top 0.n0` double")
    r = exact_moments(df, df.columns).first()
    assert tuple(r) == (1.5, 0.5, 6.0, 1.0)


def test_limbs_give_the_value_back(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.uniform(-1, 1, 500), rng.uniform(-1, 1, 500) * 2.0 ** -rng.integers(0, 60, 500), [0.0, 1.0, -1.0, 0.5]])
    df = spark.createDataFrame(pd.DataFrame({"y": y}))
    for r in df.selectExpr("y", *[f"{x} AS l{i}" for i, x in enumerate(limbs_sql("y"))]).collect():
        total = sum(r[f"l{i}"] << 20 * (3 - i) for i in range(4))
        assert abs(total - int(r.y * 2**80) if abs(r.y) > 2**-28 else total - round(r.y * 2**80)) <= 1
        assert all(0 <= r[f"l{i}"] <= 1 << 20 for i in (1, 2)) and abs(r.l0) <= 1 << 20


def test_repeated_columns_and_none(spark):
    df = spark.range(4).selectExpr("cast(id AS DOUBLE) AS a")
    assert tuple(exact_moments(df, ["a", "a"]).first()) == (1.5, math.sqrt(1.25))
    with pytest.raises(ValueError):
        exact_moments(df, [])
