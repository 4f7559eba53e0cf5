"""Model features: standardising, splines, sequences, reference lookups and guarded updates."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import MICROS
from slotweave.operators.blocks import block_of, running_sums
from slotweave.operators.gauge import as_of
from slotweave.operators.matching import bursts
from slotweave.operators.verification import finite


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0, deviation 1 per column over finite values; missing becomes the mean (0); a constant column keeps its scale.

    The moments are one row, joined as such.
    """
    ok = lambda c: F.when(finite(F.col(c)), F.col(c).cast("double"))
    m = df.agg(*[F.coalesce(F.avg(ok(c)), F.lit(0.0)).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(ok(c)).alias(f"__s_{c}") for c in columns])
    j = df.join(F.broadcast(m))
    scale = lambda c: F.when(F.col(f"__s_{c}") > 1e-12, F.col(f"__s_{c}")).otherwise(1.0)
    out = j.withColumns({f"z_{c}": F.coalesce((ok(c) - F.col(f"__m_{c}")) / scale(c), F.lit(0.0)) for c in columns})
    return out.drop(*[f"__m_{c}" for c in columns], *[f"__s_{c}" for c in columns])


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline terms beyond the linear one."""
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0))
    last, before = knots[-1], knots[-2]
    d = lambda k: (cube(k) - cube(last)) / (last - k)
    return [d(k) - d(before) for k in knots[:-2]]


def smoothed(df: DataFrame, *, key: str, us: str, row_id: str, value: str, half_min: float, reset_min: int) -> DataFrame:
    """Exponential smoothing with a weight that follows the time passed, started anew after a gap: ``row_id, smooth``."""
    rows = bursts(df.select(F.col(key).alias("station_id"), F.col(us).alias("us"), F.col(row_id).alias("row_id"), F.col(value).cast("double").alias("v")).where("us is not null and v is not null and not isnan(v)"), "station_id", "us", reset_min)

    def work(t: pa.Table) -> pa.Table:
        run, state, last, out = None, 0.0, 0, []
        for b, u, r, v in sorted(zip(*(t.column(c).to_pylist() for c in ("burst", "us", "row_id", "v")))):
            new = b != run
            state = v if new else state + (1 - 0.5 ** ((u - last) / (half_min * 60 * MICROS))) * (v - state)
            run, last = b, u
            out.append((r, state))
        return pa.table({"row_id": pa.array([x[0] for x in out], pa.int64()), "smooth": pa.array([x[1] for x in out], pa.float64())})

    return rows.groupBy("station_id", "block").applyInArrow(work, "row_id long, smooth double")


def nearest_within(left: DataFrame, right: DataFrame, *, key: str, left_us: str, right_us: str, value: str, row_id: Sequence[str], within_min: int) -> DataFrame:
    """The nearest right row either way within the tolerance, the earlier of two equally near: two bucketed as-of lookups."""
    a = dict(key=key, left_us=left_us, right_us=right_us, value=value, row_id=[*row_id, left_us], within_min=within_min)
    back = as_of(left, right, **a)
    ahead = as_of(left, right, forward=True, **a).withColumnsRenamed({"found_us": "__au", "found": "__av"})
    j = back.join(ahead, [*row_id, left_us])
    first = F.col("__au").isNull() | (F.col(left_us) - F.col("found_us") <= F.col("__au") - F.col(left_us))
    take = F.col("found_us").isNotNull() & first
    return j.select(*row_id, F.when(take, F.col("found_us")).otherwise(F.col("__au")).alias("found_us"), F.when(take, F.col("found")).otherwise(F.col("__av")).alias("found"))


def guarded_update(old: DataFrame, new: DataFrame, key: str, value: str, evidence: str, least_change: float, least_evidence: int) -> DataFrame:
    """New values only where they move far enough on enough evidence; else the old ones; unmatched rows stay."""
    j = old.select(key, F.col(value).alias("__o")).join(new.select(key, F.col(value).alias("__n"), F.col(evidence).alias("__e")), key, "full")
    moved = (F.abs(F.col("__n") - F.col("__o")) >= least_change) & (F.col("__e") >= least_evidence)
    keep = F.col("__n").isNull() | (F.col("__o").isNotNull() & ~F.coalesce(moved, F.lit(False)))
    return j.select(key, F.when(keep, F.col("__o")).otherwise(F.col("__n")).alias(value), (~keep & F.col("__o").isNotNull()).alias("changed"))


def eviction(files: DataFrame, size: str, used: str, tie: str, cap: int) -> DataFrame:
    """Files to drop so that the most recently used ones stay within the cap (``evict``).

    Running sums from the last use back go over hours of use with one carried row each.
    """
    hour = F.coalesce(block_of(-F.unix_micros(F.col(used).cast("timestamp")), 3600 * MICROS), F.lit(1 << 60))  # unused ones last
    r = running_sums(files.withColumn("__g", F.lit(1)), ["__g"], [F.col(used).desc_nulls_last(), F.col(tie)], hour, {"__to": F.col(size)})
    return r.withColumn("evict", F.col("__to") > cap).drop("__g", "__to")


def corridor(grid: DataFrame, points: DataFrame, *, length: int, width: int, value: str, threshold: float) -> DataFrame:
    """Upstream along the row: greatest value near and far, distance to the first echo, wet share, mean. Offsets meet cells by an equi-join."""
    offs = [(s, c) for s in range(1, length + 1) for c in range(-width, width + 1)]
    o = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c in offs]))
    p = points.select("id", "row", "col", o.alias("o")).select("id", "o.s", (F.col("row") + F.col("o.c")).alias("row"), (F.col("col") - F.col("o.s")).alias("col"))
    j = p.join(grid.select("row", "col", F.col(value).alias("v")), ["row", "col"])
    return j.groupBy("id").agg(
        F.max(F.when(F.col("s") * 2 <= length, F.col("v"))).alias("near_max"), F.max("v").alias("far_max"), F.min(F.when(F.col("v") >= threshold, F.col("s"))).alias("first_echo"),
        F.avg((F.col("v") >= threshold).cast("double")).alias("wet_share"), F.avg("v").alias("mean"), F.count("v").alias("n"),
    )
