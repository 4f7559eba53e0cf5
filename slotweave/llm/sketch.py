"""Percentiles of very large numeric columns with a bounded relative error, mergeable over partitions and days.

A value x falls into the bucket ``ceil(log(|x|) / log(g))`` of its sign, ``g = (1 + a) / (1 - a)``; zero has a bucket of its own.
Every bucket's middle is within the relative error ``a`` of all values in it. Counts of equal buckets are added,
so sketches of parts (partitions, days) combine without loss, and a percentile read from the counts is within ``a`` of
the value at that rank.

Scale: bucketing and counting are hash aggregates with map-side combine; what is shuffled is bounded by groups x
buckets (some thousand buckets hold all doubles), whatever the number of rows or the size of the largest group. The running
sum is taken over buckets, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bucket_of(x: Column, accuracy: float) -> Column:
    """Signed order-keeping bucket number as ``long``: negative values below 0, zero 0, positive above.

    The number of a positive value's bucket is shifted by 2^20 so that signs do not overlap. The logarithm is rounded to
    nine places, so that engines agree at the edges.
    """
    g = math.log((1 + accuracy) / (1 - accuracy))
    k = F.ceil(F.round(F.log(F.abs(x)) / F.lit(g), 9)).cast("long") + F.lit(1 << 20).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, k).otherwise(-k)


def value_of(bucket: Column, accuracy: float) -> Column:
    """The middle of a bucket."""
    g = (1 + accuracy) / (1 - accuracy)
    size = F.pow(F.lit(g), (F.abs(bucket) - F.lit(1 << 20)).cast("double")) * F.lit(2.0 / (1 + g))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, size).otherwise(-size)


def sketch(df: DataFrame, *, groups: Sequence[str], values: Sequence[str], accuracy: float = 0.01) -> DataFrame:
    """Counts per bucket: ``groups, metric, bucket, n``. Null, NaN and infinite values are left out; a null group is a group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values]))
    long = df.select(*groups, pairs.alias("p")).select(*groups, "p.metric", "p.x")
    long = long.where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    return long.groupBy(*groups, "metric", bucket_of(F.col("x"), accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add sketches of the same accuracy; ``groups`` may leave out columns, e.g. the day."""
    whole = sketches[0]
    for s in sketches[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sk: DataFrame, *, groups: Sequence[str], probabilities: Sequence[float], accuracy: float = 0.01) -> DataFrame:
    """``groups, metric, n, p<..>`` with the bucket middle at rank ``floor(p * (n - 1))`` (from 0) for each probability."""
    by = [*groups, "metric"]
    seen = F.sum("n").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    all_ = F.sum("n").over(W.partitionBy(*by))
    run = sk.select(*by, "bucket", "n", seen.alias("__seen"), all_.alias("__all"))
    name = lambda p: "p" + f"{p * 100:g}".replace(".", "_")
    at = lambda p: F.min(F.when(F.col("__seen") > F.floor(F.lit(p) * (F.col("__all") - 1)), F.col("bucket")))
    one = run.groupBy(*by).agg(F.max("__all").alias("n"), *[at(p).alias(name(p)) for p in probabilities])
    return one.select(*by, "n", *[value_of(F.col(name(p)), accuracy).alias(name(p)) for p in probabilities])


def significant(x: Column, digits: int = 9) -> Column:
    """Rounded to so many significant digits, however small or large (a fixed number of decimals would break the relative bound)."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")
