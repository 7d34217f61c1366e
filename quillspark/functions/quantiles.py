"""Exact, linearly interpolated percentiles (numpy's default method) with bounded task memory.

Spark's exact ``percentile`` aggregate keeps every distinct value of the column in the
buffer of one final task: unbounded at scale. Here:

1. one pass builds a ``percentile_approx`` sketch (rank error <= n / accuracy) and brackets
   each target rank inside a value band [lo, hi] that provably contains it;
2. one pass combines band rows per distinct value, and the rows below and above each band under a
   single key each (map-side partial aggregation, so ties, hot values and the rest all collapse before
   the shuffle); few rows or many take the same path;
3. the band's distinct values (at most ~6 n / accuracy per percentile) are dealt by ranges of (group, percentile, value), about
   ``range_values`` to a task; the ranges' counts are added up in order (a row per range), and only the ranges that hold one
   of the two order statistics around the virtual index are ranked. These are interpolated exactly as numpy does.

Ungrouped, the sketch bounds are a one-row result attached as literals (``with_scalars``);
grouped (``by``), they are joined on the group keys. The result is a
DataFrame with one row (per group). Null and NaN inputs are ignored, like numpy on a cleaned column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import with_scalars
from quillspark.session import materialize

DEFAULT_ACCURACY = 100_000
#: Distinct values of the bands that a range aims at: no task ranks more than a small multiple of it.
RANGE_VALUES = 500_000


def numpy_lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's ``_lerp``: ``a + (b-a)*t``, computed from ``b`` when ``t >= 0.5`` (monotone, exact at t = 1)."""
    d = b - a
    return F.when(t >= F.lit(0.5), b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def virtual_index(n: Column, q: Column) -> Column:
    """numpy's linear-method virtual index ``(n - 1) * q`` (0-based rank to interpolate at)."""
    return (n - 1).cast("double") * q


def _attach(df: DataFrame, small: DataFrame, by: Sequence[str], few_groups: bool = False) -> DataFrame:
    """Attach per-group values: literals from the one-row result when ungrouped, else an equi-join on
    the group keys (one row per group; Spark broadcasts it when its measured size allows). ``few_groups`` broadcasts it in any
    case: dealt by a few keys, all rows would meet in as few tasks."""
    return with_scalars(df, small) if not by else df.join(F.broadcast(small) if few_groups else small, list(by))


def value_ranges(members: DataFrame, by: Sequence[str], range_values: int) -> DataFrame:
    """``members`` with ``__part``: a number of ranges in the order of (group, percentile, class, value). A single range where
    the members are few; written otherwise, since the bounds of ranges are drawn anew each time that they are computed."""
    members = materialize(members)
    parts = -(-members.count() // range_values)
    if parts <= 1:
        return members.withColumn("__part", F.lit(0))
    dealt = members.repartitionByRange(int(parts), *by, "__pid", "__cls", "__key")
    return materialize(dealt.withColumn("__part", F.spark_partition_id()))


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str] | None = None,
                      accuracy: int = DEFAULT_ACCURACY, by: Sequence[str] = (), range_values: int = RANGE_VALUES, few_groups: bool = False) -> DataFrame:
    """One row (per group of ``by``) with one double column per probability (``names`` or ``p0, p1, ...``). ``few_groups`` says that
    the number of groups is bounded by parameters, so that a row for each can be broadcast."""
    names = list(names or [f"p{i}" for i in range(len(probs))])
    by = list(by)
    eps = 3.0 / accuracy
    x = F.col(col).cast("double")
    vals = df.select(*by, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))

    band_probs: list[float] = []
    for p in probs:
        band_probs += [max(0.0, p - eps), min(1.0, p + eps)]
    sketch = vals.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"),
                                   F.percentile_approx("__x", band_probs, accuracy).alias("__band"))
    m = len(probs)
    bands = sketch.select(*by, "__n", *[F.col("__band")[2 * i].alias(f"__lo{i}") for i in range(m)],
                          *[F.col("__band")[2 * i + 1].alias(f"__hi{i}") for i in range(m)])

    marked = _attach(vals, bands, by, few_groups)
    los = F.array(*[F.col(f"__lo{k}") for k in range(m)])
    his = F.array(*[F.col(f"__hi{k}") for k in range(m)])
    # One pass for every percentile. Rows below the band (class 0) and above it (class 2) combine into one row per
    # task each, which keeps the value next to the band: the sketch is exact on few rows, where the two order
    # statistics may straddle the band's edge. Rows inside (class 1) combine per value. __n rides along as a key.
    cls = lambda i: F.when(F.col("__x") < F.get(los, i), 0).when(F.col("__x") > F.get(his, i), 2).otherwise(1)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(
        i.alias("pid"), cls(i).alias("cls"), F.when(cls(i) == 1, F.col("__x")).alias("key")))
    members = (marked.select(*by, "__n", "__x", F.explode(keyed).alias("__e"))
               .groupBy(*by, "__n", F.col("__e.pid").alias("__pid"), F.col("__e.cls").alias("__cls"), F.col("__e.key").alias("__key"))
               .agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__min"), F.max("__x").alias("__max")))

    ranges = value_ranges(members, by, range_values)
    group = [*by, "__pid"]
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*group, "__part", "__n").agg(F.sum("__c").alias("__tot"))
    q_p = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("__pid"))
    vidx = virtual_index(F.col("__n"), q_p)
    j0 = F.floor(vidx)
    j1 = F.least(j0 + 1, F.col("__n") - 1)
    totals = totals.select(*group, "__part", "__tot", F.coalesce(F.sum("__tot").over(before), F.lit(0)).alias("__before"),
                           j0.alias("__j0"), j1.alias("__j1"), (vidx - j0).alias("__t"))
    holds = lambda j: (F.col("__before") <= F.col(j)) & (F.col(j) < F.col("__before") + F.col("__tot"))
    chosen = totals.where(holds("__j0") | holds("__j1")).drop("__tot")  # at most two ranges per group and percentile

    w = Window.partitionBy(*group, "__part").orderBy("__cls", "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.col("__cls") == 0, F.col("__max")).otherwise(F.col("__min"))
    ranked = ranges.drop("__n").join(chosen, [*group, "__part"]).select(*group, edge.alias("__x"), (F.sum("__c").over(w) + F.col("__before")).alias("__upto"),
                                                                    "__j0", "__j1", "__t")
    at = lambda j: F.min_by("__x", F.when(F.col("__upto") > F.col(j), F.col("__upto")))
    picked = ranked.groupBy(*group).agg(at("__j0").alias("__a"), at("__j1").alias("__b"), F.first("__t").alias("__t"))
    value = numpy_lerp(F.col("__a"), F.col("__b"), F.col("__t"))
    # pivot the (pid, value) rows into one row per group; m rows per group only
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("__pid") == i, value)).alias(nm) for i, nm in enumerate(names)])
