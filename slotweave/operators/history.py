"""Full history of changing attributes from periodic snapshots (gaps and islands).

Steps: (1) all snapshots of one (entity, effective time) shrink to the last fetched non-null value
of each attribute — a hash aggregate with map-side combine, so a hot entity is reduced before the
shuffle; (2) a hash of the attributes is compared with the version before by ``lag``; equal hashes are
the same value, differing ones are held against the tolerances; (3) the running sum of the change
marks numbers the islands; (4) the minimum of an island and the next island's start give validity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.geo import haversine_km


def lon_lat(pair: Column, lon_range: tuple[float, float] = (-180.0, 180.0), lat_range: tuple[float, float] = (-90.0, 90.0)) -> Column:
    """``struct<lon, lat>`` of a two-element array written in either order; null if it is no position.

    The order is swapped only when the pair fits the ranges that way round and not as written.
    """
    a, b = F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))
    fits = lambda x, y: x.between(*lon_range) & y.between(*lat_range)
    made = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.when((F.size(pair) == 2) & a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b), F.when(fits(a, b) | ~fits(b, a), made(a, b)).otherwise(made(b, a)))


def last_known(df: DataFrame, *, entity: str, effective: str, fetched: str, tie: str, attributes: Mapping[str, Column]) -> DataFrame:
    """One row per (entity, effective time): of each attribute the last fetched non-null value.

    Of rows fetched at one instant the greatest ``tie`` counts. Rows without entity or effective time
    tell nothing; a row without fetch time is older than any other.
    """
    rows = df.select(
        F.col(entity).alias("entity"),
        F.col(effective).alias("effective"),
        F.struct(F.coalesce(F.unix_micros(F.col(fetched)), F.lit(-(2**62))).alias("f"), F.col(tie).alias("t")).alias("__o"),
        *[c.alias(n) for n, c in attributes.items()],
    ).where(F.col("entity").isNotNull() & F.col("effective").isNotNull())
    return rows.groupBy("entity", "effective").agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("__o"))).alias(n) for n in attributes])


def mark_changes(versions: DataFrame, *, attributes: Sequence[str], same: Mapping[str, object]) -> DataFrame:
    """Adds ``changed`` and ``island`` to one row per (entity, effective).

    An attribute unknown in a version keeps the value known before; a change is marked only
    between known values. ``same[name](now, before)`` is a condition under which two unequal values are one.
    The first version of an entity starts island 1 and is no change.
    """
    w = W.partitionBy("entity").orderBy("effective")
    kept = versions
    for a in attributes:
        kept = kept.withColumn(a, F.last(a, ignorenulls=True).over(w))
    kept = kept.withColumn("__hash", F.xxhash64(*[F.col(a) for a in attributes]))
    kept = kept.withColumn("__before", F.lag(F.struct("__hash", *attributes)).over(w))
    differs = F.lit(False)
    for a in attributes:
        now, old = F.col(a), F.col(f"__before.{a}")
        differs = differs | F.coalesce(~same[a](now, old), F.lit(False))
    changed = F.col("__before").isNotNull() & (F.col("__hash") != F.col("__before.__hash")) & differs
    return (
        kept.withColumn("changed", F.coalesce(changed, F.lit(False)))
        .withColumn("island", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) + 1)
        .drop("__hash", "__before")
    )


def islands(marked: DataFrame, *, attributes: Sequence[str]) -> DataFrame:
    """Validity periods: ``entity, island, valid_from, valid_to`` (null: still valid) and the island's first known attributes."""
    one = marked.groupBy("entity", "island").agg(
        F.min("effective").alias("valid_from"),
        F.count(F.lit(1)).alias("n_versions"),
        *[F.min_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("effective"))).alias(a) for a in attributes],
    )
    return one.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("entity").orderBy("valid_from")))


def same_number(tolerance: float):
    """Values less than ``tolerance`` apart are the same."""
    return lambda now, old: F.abs(now - old) < F.lit(tolerance)


def same_place(metres: float):
    """Positions (``struct<lon, lat>``) less than ``metres`` apart are the same."""
    return lambda now, old: haversine_km(now["lat"], now["lon"], old["lat"], old["lon"]) * 1000 < F.lit(metres)
