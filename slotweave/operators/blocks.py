"""Order-dependent steps over long series without one task per key.

A key's series is cut into blocks of fixed length in the order column. What a step needs from further back comes either
as a *margin* (neighbouring rows copied to the block) or as a *carry* (one summary row a block, run over a key's blocks and joined back).
So a key with a third of all rows is spread over its blocks, and the only window over a whole key runs over its block summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def block_of(order: Column, width: int | float) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def with_margin(df: DataFrame, order: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Adds ``block`` and ``core``: each row in its own block (core) and copied to blocks that need it as margin.

    A block sees the rows from ``before`` before its begin to ``after`` after its end; both at most ``width``.
    """
    own = block_of(F.col(order), width)
    ways = [own] + ([block_of(F.col(order) + F.lit(before), width)] if before else []) + ([block_of(F.col(order) - F.lit(after), width)] if after else [])
    rows = df.withColumn("block", F.explode(F.array_distinct(F.array(*ways))))
    return rows.withColumn("core", F.col("block") == own)


def carried(df: DataFrame, keys: Sequence[str], block: str, summary: dict[str, Column], run: dict[str, tuple[str, Column]]) -> DataFrame:
    """Joins to every row what the earlier blocks of its key add up to.

    ``summary``: aggregates of one block. ``run``: name to (``sum``, ``last`` or ``max``, column over the summary): taken over all earlier blocks of the key.
    Null keys form a key of their own. Null where there is no earlier block (sums: 0).
    """
    w = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    over = {"sum": lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)), "last": lambda c: F.last(c, ignorenulls=True).over(w), "max": lambda c: F.max(c).over(w)}
    one = df.groupBy(*keys, block).agg(*[c.alias(n) for n, c in summary.items()])
    one = one.select(*[F.col(k).alias(f"__k_{k}") for k in [*keys, block]], *[over[how](c).alias(n) for n, (how, c) in run.items()])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, block]]
    return df.join(one, on, "left").drop(*[f"__k_{k}" for k in [*keys, block]])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums in the given order; ``block`` must not fall in that order (negate it for descending)."""
    d = df.withColumn("__b", block).withColumns({f"__v_{n}": c for n, c in sums.items()})
    d = carried(d, keys, "__b", {f"__s_{n}": F.sum(f"__v_{n}") for n in sums}, {f"__c_{n}": ("sum", F.col(f"__s_{n}")) for n in sums})
    w = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(w), F.lit(0)) + F.col(f"__c_{n}") for n in sums})
    return d.drop("__b", *[f"__v_{n}" for n in sums], *[f"__c_{n}" for n in sums])


def previous(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """Adds ``__prev``: the ``order`` value of the row before (equal values may be each other's), null for a key's first row."""
    d = df.withColumn("__b", block_of(F.col(order), width))
    d = carried(d, keys, "__b", {"__m": F.max(order)}, {"__c": ("max", F.col("__m"))})
    w = W.partitionBy(*keys, "__b").orderBy(order)
    return d.withColumn("__prev", F.coalesce(F.lag(order).over(w), F.col("__c"))).drop("__b", "__c")


def run_numbers(df: DataFrame, keys: Sequence[str], order: str, gap: int, width: int, name: str = "run") -> DataFrame:
    """Adds ``name``: 0, 1, ... for stretches of rows at most ``gap`` apart, and ``__start``, where the stretch began; rows with equal ``order`` share a run.

    Gaps inside a block are found there; one summary row a block (first, last, gaps, last begin) settles the borders and carries number and begin on.
    """
    w = W.partitionBy(*keys, "__blk").orderBy(order)
    d = df.withColumn("__blk", block_of(F.col(order), width))
    d = d.withColumn("__new", F.when(F.col(order) - F.lag(order).over(w) > F.lit(gap), 1).otherwise(0))
    upto = w.rangeBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"__in": F.sum("__new").over(upto), "__begin": F.max(F.when(F.col("__new") == 1, F.col(order))).over(upto)}).drop("__new")
    one = d.groupBy(*keys, "__blk").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.max("__in").alias("n"), F.max("__begin").alias("s"))
    k = W.partitionBy(*keys).orderBy("__blk")
    one = one.withColumn("f", F.when(F.lag("b").over(k).isNull(), 0).when(F.col("a") - F.lag("b").over(k) > F.lit(gap), 1).otherwise(0)).withColumn("h", F.row_number().over(k) == 1)
    own = F.when(F.col("h") | (F.col("f") == 1), F.col("a"))
    one = one.withColumns({
        "__off": F.sum("f").over(k) + F.coalesce(F.sum("n").over(k.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "__from": F.coalesce(own, F.last(F.coalesce("s", own), ignorenulls=True).over(k.rowsBetween(W.unboundedPreceding, -1))),
    }).select(*[F.col(c).alias(f"__k_{c}") for c in [*keys, "__blk"]], "__off", "__from")
    j = d.join(one, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*keys, "__blk"]]).drop(*[f"__k_{c}" for c in [*keys, "__blk"]])
    j = j.withColumns({name: (F.col("__in") + F.col("__off")).cast("long"), "__start": F.coalesce("__begin", "__from")})
    return j.drop("__blk", "__in", "__begin", "__off", "__from")


def last_before(left: DataFrame, right: DataFrame, *, key: str, left_us: str, right_us: str, value: str, width: int) -> DataFrame:
    """Adds ``value`` of the last right row of the key at or before the left row's time, however long ago; null where there is none.

    Of right rows at one instant the greatest value counts. Both sides are put on one axis; what lies in earlier blocks is carried as one row a block. No range join.
    """
    both = left.select("*", F.col(left_us).alias("__us"), F.lit(None).alias("__v"), F.lit(1).alias("__side"))
    held = right.select(F.col(key), F.col(right_us).alias("__us"), F.struct(F.col(right_us).alias("u"), F.col(value).alias("v")).alias("__v"), F.lit(0).alias("__side"))
    both = both.drop("__v").withColumn("__v", F.lit(None).cast(held.schema["__v"].dataType)).unionByName(held.where(F.col("__us").isNotNull()), allowMissingColumns=True)
    both = both.withColumn("__blk", block_of(F.col("__us"), width))
    both = carried(both, [key], "__blk", {"__m": F.max("__v")}, {"__c": ("max", F.col("__m"))})
    w = W.partitionBy(key, "__blk").orderBy("__us", "__side").rowsBetween(W.unboundedPreceding, 0)
    got = F.coalesce(F.max("__v").over(w), F.col("__c"))
    return both.withColumn(value, got["v"]).where("__side = 1").drop("__us", "__v", "__side", "__blk", "__c")
