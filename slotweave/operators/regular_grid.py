"""Irregular readings onto a regular grid, with missing marks filled.

Per source a harmonic regression with trend is fitted from *normal equations*: the sums of products of the
design columns are plain aggregates (partial sums per task, one small row per source), solved
where they lie. Missing marks get the prediction plus a bridge: the residuals at the observed ends
of the gap, joined by a straight line.

Scale: one shuffle of the readings on (source, day). A source-day is at most ``DAY / step`` marks after
folding, so a source with a third of all rows is as small as any other from then on. Later
steps move one row per source and day. The coefficients are one row per source; AQE broadcasts
them only if their measured size allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import floor_us, micros, nearest_mark_us

DAY_US = 86_400_000_000


def day_arrays(df: DataFrame, *, source: str, ts: str, value: str, order: list[str], step_min: int = 10) -> DataFrame:
    """One row per (source, UTC day) on which the source fills a mark: ``source, day_us, marks map<int, double>``.

    A reading belongs to its nearest mark (exactly half way: the later one). Null and NaN values, and rows without
    source or time, fill nothing. Of several readings for a mark the one with the greatest ``order`` counts.
    """
    step = step_min * 60_000_000
    mark = nearest_mark_us(micros(ts), step)
    rows = (
        df.select(F.col(source).alias("source"), mark.alias("mark_us"), F.col(value).cast("double").alias("v"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        .where(F.col("source").isNotNull() & F.col("mark_us").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
        .withColumn("day_us", floor_us(F.col("mark_us"), DAY_US))
        .repartition(F.col("source"), F.col("day_us"))
    )
    last = F.max(F.struct(*[f"__o{i}" for i in range(len(order))], "v"))
    one = rows.groupBy("source", "day_us", "mark_us").agg(last.alias("m"))
    idx = ((F.col("mark_us") - F.col("day_us")) / F.lit(step)).cast("int")
    return one.groupBy("source", "day_us").agg(F.map_from_entries(F.collect_list(F.struct(idx.alias("k"), F.col("m.v").alias("v")))).alias("marks"))


def design(t_days: Column, harmonics: int) -> list[Column]:
    """Constant, trend and ``harmonics`` pairs of the daily cycle; ``t_days`` in days since the epoch."""
    out = [F.lit(1.0), t_days / F.lit(100.0) - F.lit(200.0)]
    for k in range(1, harmonics + 1):
        a = t_days * F.lit(2 * math.pi * k)
        out += [F.cos(a), F.sin(a)]
    return out


def fit_sources(days: DataFrame, *, harmonics: int, step_min: int, ridge: float = 1e-6) -> DataFrame:
    """``source, coef array<double>`` by distributed normal equations.

    The trend column is centred when solving. A source with fewer marks than columns gets its mean.
    """
    p = 2 + 2 * harmonics
    per_day = DAY_US / (step_min * 60_000_000)
    obs = days.select("source", "day_us", F.explode("marks").alias("k", "v"))
    t = F.col("day_us") / F.lit(float(DAY_US)) + F.col("k") / F.lit(per_day)
    obs = obs.select("source", "v", *[c.alias(f"x{i}") for i, c in enumerate(design(t, harmonics))])
    aggs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(F.col(f"x{i}") * F.col("v")).alias(f"b{i}") for i in range(p)]
    sums = obs.groupBy("source").agg(*aggs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            a, y = np.zeros((n, p, p)), np.zeros((n, p))
            for i in range(p):
                y[:, i] = b[f"b{i}"]
                for j in range(i, p):
                    a[:, i, j] = a[:, j, i] = b[f"a{i}_{j}"]
            centre = np.tile(np.eye(p), (n, 1, 1))  # x1 - mean(x1) as a change of basis
            centre[:, 1, 0] = -a[:, 0, 1] / a[:, 0, 0]
            ac, yc = centre @ a @ centre.transpose(0, 2, 1), (centre @ y[..., None])[..., 0]
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", ac), 1e-12))
            an = ac / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(p)
            c = np.linalg.solve(an, (yc / scale)[..., None])[..., 0] / scale
            few = a[:, 0, 0] < 3 * p
            c[few] = 0
            c[few, 0] = y[few, 0] / a[few, 0, 0]
            c = (c[:, None, :] @ centre)[:, 0, :]
            yield pd.DataFrame({"source": b["source"], "coef": list(c)})

    return sums.mapInPandas(solve, T.StructType([T.StructField("source", sums.schema["source"].dataType), T.StructField("coef", T.ArrayType(T.DoubleType()))]))


def regular_series(df: DataFrame, *, source: str, ts: str, value: str, order: list[str], step_min: int = 10, harmonics: int = 2, floor: float | None = None) -> DataFrame:
    """The regular series of every source on every day on which it fills at least one mark.

    Columns: ``source, slot_us, value`` (observed, else null), ``filled`` (observed, else predicted and bridged),
    ``status`` (``observed`` or ``missing``). Before the first and after the last observed mark the nearest end's
    residual is carried. ``floor`` bounds filled values below. An empty table gives no rows.
    """
    step, per_day = step_min * 60_000_000, DAY_US // (step_min * 60_000_000)
    days = day_arrays(df, source=source, ts=ts, value=value, order=order, step_min=step_min)
    coef = fit_sources(days, harmonics=harmonics, step_min=step_min)

    def predicted(day_us: Column, k: Column, c: Column) -> Column:
        t = day_us / F.lit(float(DAY_US)) + k / F.lit(float(per_day))
        terms = design(t, harmonics)
        out = terms[0] * c[0]
        for i, x in enumerate(terms[1:], 1):
            out = out + x * c[i]
        return out

    first_k, last_k = F.array_min(F.map_keys("marks")), F.array_max(F.map_keys("marks"))
    end = lambda k: F.struct((F.col("day_us") + k * F.lit(step).cast("long")).alias("us"), (F.col("marks")[k] - predicted(F.col("day_us"), k, F.col("coef"))).alias("r"))
    w = W.partitionBy("source").orderBy("day_us")
    ends = (
        days.join(coef, "source", "left")
        .withColumn("__first", end(first_k))
        .withColumn("__last", end(last_k))
        .withColumn("__before", F.lag("__last").over(w))
        .withColumn("__after", F.lead("__first").over(w))
    )
    marks = ends.select("source", "day_us", "coef", "marks", "__before", "__after", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("k"))
    slot = F.col("day_us") + F.col("k") * F.lit(step).cast("long")
    marks = marks.select("source", "day_us", slot.alias("slot_us"), F.col("marks")[F.col("k")].alias("value"), predicted(F.col("day_us"), F.col("k"), F.col("coef")).alias("__p"), "__before", "__after")
    seen = F.when(F.col("value").isNotNull(), F.struct(F.col("slot_us").alias("us"), (F.col("value") - F.col("__p")).alias("r")))
    d = W.partitionBy("source", "day_us").orderBy("slot_us")
    back = F.coalesce(F.last(seen, ignorenulls=True).over(d.rowsBetween(W.unboundedPreceding, 0)), F.col("__before"))
    ahead = F.coalesce(F.first(seen, ignorenulls=True).over(d.rowsBetween(0, W.unboundedFollowing)), F.col("__after"))
    bridged = marks.withColumn("__l", back).withColumn("__r", ahead)
    left, right = F.col("__l"), F.col("__r")
    share = (F.col("slot_us") - left["us"]) / (right["us"] - left["us"])
    bridge = F.when(left.isNull(), right["r"]).when(right.isNull() | (right["us"] == left["us"]), left["r"]).otherwise(left["r"] + share * (right["r"] - left["r"]))
    guess = F.col("__p") + bridge
    if floor is not None:
        guess = F.greatest(guess, F.lit(floor))
    return bridged.select(
        "source",
        "slot_us",
        "value",
        F.coalesce(F.col("value"), guess).alias("filled"),
        F.when(F.col("value").isNull(), "missing").otherwise("observed").alias("status"),
    )
