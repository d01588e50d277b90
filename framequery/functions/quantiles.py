"""Exact quantiles of a whole column without one task that holds all its values.

Values are counted by buckets that keep their order (even steps between the ends, refined by steps of the inverse
hyperbolic sine, so that neither a narrow crowd nor a far outlier fills one). The running counts over the buckets, whose
number is bounded, tell which ones hold the ranks asked for; only the values in these are counted one by one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS, FINE = 1 << 16, 256
#: More than the refining steps of any double.
SPAN = 1 << 20


def percentiles(df: DataFrame, x: Column, shares: list[float]) -> DataFrame:
    """One row with ``v``: the type 7 quantiles of x at the shares, missing values left out; null without values."""
    own = df.select(x.cast("double").alias("x")).where("x is not null")
    ends = own.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).alias("v")).scalar()
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    # halved before the difference, which may be beyond the largest double
    step = F.coalesce(F.floor(F.try_divide(F.col("x") / 2 - lo / 2, hi / 2 - lo / 2) * STEPS), F.lit(0).cast("long"))
    placed = own.withColumn("b", step * SPAN + F.floor(F.asinh("x") * FINE) + SPAN // 2)
    upto = F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0))
    counts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", (upto - F.col("n")).alias("before"), upto.alias("upto"))
    places = [F.lit(float(p)) * (n - 1) for p in shares]
    ranks = [(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in places]
    # subqueries may not stand in lambdas: the ranks are compared one by one
    among = lambda first, end: reduce(or_, [(r >= F.col(first)) & (r < F.col(end)) for pair in ranks for r in pair])
    held = counts.where(among("before", "upto")).select("b", "before")
    inside = placed.join(F.broadcast(held), "b").groupBy("b", "before", "x").agg(F.count(F.lit(1)).alias("k"))
    run = F.sum("k").over(W.partitionBy("b").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    ranked = inside.select("x", (F.col("before") + run - F.col("k")).alias("first"), (F.col("before") + run).alias("end"))
    names = [(f"low{i}", f"high{i}") for i in range(len(ranks))]
    marked = ranked.where(among("first", "end")).select(*[F.when((r >= F.col("first")) & (r < F.col("end")), F.col("x")).alias(k) for pair, ks in zip(ranks, names, strict=True) for r, k in zip(pair, ks, strict=True)])
    found = marked.agg(*[F.max(k).alias(k) for ks in names for k in ks])

    def value(p: Column, rank: tuple, ks: tuple) -> Column:
        low, high = map(F.col, ks)
        return F.when(low == high, low).otherwise((rank[1] - p) * low + (p - rank[0]) * high)

    return found.select(F.when(n > 0, F.array(*map(value, places, ranks, names))).alias("v"))
