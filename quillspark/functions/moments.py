"""Mean and standard deviation that are the same to the last bit however the rows are partitioned.

Sums of doubles depend on the order in which partial sums meet. Here a value is scaled by a power of two above the column's
largest magnitude and cut into four whole numbers of 20 bits; whole numbers add up alike in any order. Deviations from
the mean go the same way, so nothing cancels. Three aggregations of one row each, no shuffle of rows, nothing on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.exprs import ref, with_scalars

LIMB_BITS = 20
LIMBS = 4
LEAST_EXPONENT = -900  # columns of smaller magnitudes are scaled as if they had this one


def limbs_sql(y: str) -> list[str]:
    """Whole numbers l1..l4 with ``y = l1 2^-20 + l2 2^-40 + l3 2^-60 + l4 2^-80`` for -1 <= y <= 1, the last one rounded.
    Scaling by a power of two and the differences are exact."""
    base = 1 << LIMB_BITS
    cut = [f"floor({y} * {float(base ** k)!r}D)" for k in range(1, LIMBS)]
    upper = [cut[0]] + [f"{b} - {a} * {base}L" for a, b in zip(cut, cut[1:])]
    return [*upper, f"CAST(rint({y} * {float(base ** LIMBS)!r}D - CAST({cut[-1]} AS DOUBLE) * {float(base)!r}D) AS BIGINT)"]


def _limb_sums(y: str) -> list[Column]:
    return [F.expr(f"sum({limb})").alias(f"l{k}") for k, limb in enumerate(limbs_sql(y))]


# the sum of a column as a double in units of 2^-80, rounded once; 2^43 rows (8.8e12) cannot overflow
TOTAL = "CAST(" + " + ".join(
    f"CAST(CAST(l{k} AS DECIMAL(20,0)) * CAST({1 << LIMB_BITS * (LIMBS - 1 - k)} AS DECIMAL(19,0)) AS DECIMAL(38,0))"
    for k in range(LIMBS)) + " AS DOUBLE)"
UNIT = f"pow(2.0D, -{LIMB_BITS * LIMBS}.0D)"
FINITE = "top < double('inf')"  # NaN is above every number
NAN = "CAST('NaN' AS DOUBLE)"


def _sorted_rows(by_column: DataFrame) -> Column:
    """All rows of a table of one row per column as an array in the order of the columns."""
    return F.sort_array(F.collect_list(F.struct(*by_column.columns))).alias("c")


def _with_row_of_column(x: DataFrame, by_column: DataFrame) -> DataFrame:
    """Every value with the fields of its column's row."""
    fields = [c for c in by_column.columns if c != "i"]
    return with_scalars(x, by_column.agg(_sorted_rows(by_column))).select("i", "x", F.expr("c[i]").alias("r")).select("i", "x", *[f"r.{c}" for c in fields])


def exact_moments(df: DataFrame, cols: Sequence[str], ddof: int = 0, mean: str = "__mu_{}", std: str = "__sd_{}") -> DataFrame:
    """One row with mean and standard deviation (``ddof`` 0: population, 1: sample) of every column, bit-equal for any
    partitioning and order of the rows.

    Nulls are left out. No values: null, null. Fewer than ``ddof + 1`` values: the deviation is null. A NaN or an infinity in a
    column makes both NaN. Equal values: they are the mean, and the deviation is zero. The mean of values of one sign is right
    to a few units of the last place, the variance to 2^-52 or, if that is more, n 2^-76 of itself for n rows.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        raise ValueError("no columns")
    # a row per value: one short aggregation for any number of columns, combined to a row per column before the shuffle
    x = df.select(F.posexplode(F.array(*[F.col(ref(c)).cast("double") for c in cols])).alias("i", "x"))
    # powers of two above the magnitude of the values (e) and above the distance of any two (f)
    above = f"CASE WHEN {FINITE} THEN greatest(coalesce(ceil(log2(nullif({{}}, 0.0D))) + {{}}, 0), {LEAST_EXPONENT}) ELSE 0 END"
    top = (x.groupBy("i").agg(F.max(F.abs("x")).alias("top"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
           .withColumn("e", F.expr(above.format("top", 1)).cast("double"))
           .withColumn("f", F.expr(above.format("hi * 0.5D - lo * 0.5D", 2)).cast("double")).withColumn("p", F.expr("pow(2.0D, -e)")))
    held = ["top", "lo", "hi", "n", "e", "f", "p"]
    keep = [F.max(c).alias(c) for c in held]
    # values of a column that is not finite count as null: its moments are NaN whatever they are
    scaled = _with_row_of_column(x, top).withColumn("y", F.expr(f"CASE WHEN {FINITE} THEN x * p END"))
    first = scaled.groupBy("i").agg(*keep, *_limb_sums("y")).withColumn(
        "m", F.expr(f"CASE WHEN lo = hi THEN lo * p WHEN n > 0 THEN {TOTAL} / n * {UNIT} END"))
    centred = _with_row_of_column(x, first.select("i", *held, "m")).withColumn(
        "d", F.expr(f"CASE WHEN {FINITE} THEN (x * p - m) * pow(2.0D, e - f) END"))
    second = centred.withColumn("y", F.expr("d * d")).groupBy("i").agg(*keep, F.max("m").alias("m"), *_limb_sums("y"))
    back = "8.0D * pow(2.0D, {} - 3.0D)"
    done = second.select(
        "i", F.expr(f"CASE WHEN n = 0 THEN NULL WHEN NOT ({FINITE}) THEN {NAN} ELSE m * {back.format('e')} END").alias("mean"),
        F.expr(f"CASE WHEN n <= {ddof} THEN NULL WHEN NOT ({FINITE}) THEN {NAN} "
               f"ELSE sqrt({TOTAL} / (n - {ddof}) * {UNIT}) * {back.format('f')} END").alias("std"))
    row = done.agg(_sorted_rows(done))
    return row.select(*[F.expr(f"get(c, {i}).{part}").alias(name.format(c)) for i, c in enumerate(cols) for part, name in (("mean", mean), ("std", std))])
