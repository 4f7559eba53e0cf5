"""Dealing places to cells: floors, capacities and largest remainders over small tables of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def allocate(cells: DataFrame, key: str, size: str, *, total: int | Column, floor: int, by: Sequence[str] = ()) -> DataFrame:
    """``by, key, n, seats``: ``total`` places dealt to cells (one row each) that hold ``size`` at most.

    First every cell gets ``floor`` (or all it holds), in order of the key, as far as the total goes; the rest is dealt in proportion to the room left, whole parts first, then one each by largest
    remainder (ties by key). As no quota exceeds its cell's room, one round deals everything. ``cells`` is a table of counts, not of rows.
    """
    t = F.lit(total) if isinstance(total, int) else total
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    first = F.least(F.lit(floor), F.col("n"))
    c = cells.select(*by, key, F.col(size).alias("n"), t.alias("__t"))
    before = F.coalesce(F.sum(first).over(every.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("__got", F.greatest(F.lit(0), F.least(first, F.col("__t") - before)))
    c = c.withColumn("__room", F.col("n") - F.col("__got")).withColumn("__free", F.sum("__room").over(every))
    c = c.withColumn("__share", F.least(F.col("__t") - F.sum("__got").over(every), F.col("__free")))
    c = c.withColumn("__q", F.when(F.col("__free") > 0, F.col("__share") * F.col("__room") / F.col("__free").cast("double")).otherwise(0.0))
    rest = F.col("__share") - F.sum(F.floor("__q")).over(every)
    rank = F.row_number().over(every.orderBy(F.round(F.col("__q") - F.floor("__q"), 9).desc(), key))
    more = F.when((rank <= rest) & (F.floor("__q") < F.col("__room")), 1).otherwise(0)
    return c.withColumn("seats", (F.col("__got") + F.floor("__q") + more).cast("long")).select(*by, key, "n", "seats")
