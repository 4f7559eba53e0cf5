"""Isotonic calibration: ties are pooled in Spark, adjacent violators chunk by chunk and then across chunks; applied by interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.operators.blocks import block_of, carried
from slotweave.operators.verification import ratio

#: Probabilities are cut into so many chunks, so that no task holds a group's whole curve.
CHUNKS = 1024


def pooled(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, weight, number of entries) of the pooled blocks of the non-decreasing fit to ``y`` with weights ``w``."""
    mean, weight, size = [], [], []
    for a, b in zip(y.tolist(), w.tolist()):
        mean.append(a)
        weight.append(b)
        size.append(1)
        while len(mean) > 1 and mean[-2] > mean[-1]:
            t = weight[-2] + weight[-1]
            mean[-2] = (mean[-2] * weight[-2] + mean[-1] * weight[-1]) / t
            weight[-2], size[-2] = t, size[-2] + size[-1]
            del mean[-1], weight[-1], size[-1]
    return np.asarray(mean, float), np.asarray(weight, float), np.asarray(size, np.int64)


def pool_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ``y`` with weights ``w``; equal neighbours stay apart."""
    mean, _, size = pooled(y, w)
    return np.repeat(mean, size)


def isotonic(valid: DataFrame, by: Sequence[str], *, weighted: bool = True) -> DataFrame:
    """``by, p, fitted, sum_w``: the calibration curve of each group at its distinct probabilities.

    ``valid``: ``by, p, y, w``. Unweighted, every distinct probability counts alike. Neighbours that are out of order within a chunk of probabilities are out of order
    in the whole as well, so chunks are pooled first and a group's task sees pooled blocks only. Exact: no probability is rounded. Null groups are groups.
    """
    d = valid.groupBy(*by, "p").agg(F.sum("w").alias("sum_w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.avg("y").alias("my"))
    d = d.withColumn("chunk", block_of(F.col("p"), 1.0 / CHUNKS)).withColumn("m", ratio(F.col("wy"), F.col("sum_w")) if weighted else F.col("my")).withColumn("u", F.col("sum_w") if weighted else F.lit(1.0))
    names = ", ".join(f"`{c}` {valid.schema[c].dataType.simpleString()}" for c in by)
    same = lambda key, t, n: {c: pa.array([k.as_py()] * n, t.schema.field(c).type) for c, k in zip(by, key)}

    def chunk(key: tuple, t: pa.Table) -> pa.Table:
        p, m, u, sw = (t.column(c).to_numpy() for c in ("p", "m", "u", "sum_w"))
        o = np.argsort(p)
        mean, weight, size = pooled(m[o], u[o])
        at = np.repeat(np.arange(len(size)), size)
        return pa.table({**same(key, t, len(p)), "chunk": pa.array([key[-1].as_py()] * len(p), pa.int64()), "k": pa.array(at), "p": p[o], "mean": mean[at], "weight": weight[at], "sum_w": sw[o]})

    parts = d.groupBy(*by, "chunk").applyInArrow(chunk, f"{names}, chunk long, k long, p double, mean double, weight double, sum_w double")
    blocks = parts.groupBy(*by, "chunk", "k").agg(F.first("mean").alias("mean"), F.first("weight").alias("weight"))

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        c, k, m, u = (t.column(x).to_numpy() for x in ("chunk", "k", "mean", "weight"))
        o = np.lexsort((k, c))
        return pa.table({**same(key, t, len(o)), "chunk": pa.array(c[o]), "k": pa.array(k[o]), "fitted": pool_violators(m[o], u[o])})

    fit = blocks.groupBy(*by).applyInArrow(whole, f"{names}, chunk long, k long, fitted double").withColumnsRenamed({c: f"__{c}" for c in [*by, "chunk", "k"]})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, "chunk", "k"]]
    return parts.join(fit, on).select(*by, "p", "fitted", "sum_w")


def apply_curve(rows: DataFrame, curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``calibrated``: linear between curve points, clamped at the ends; null without a curve or a probability.

    Distinct (group, p) meet the curve by a union and two looks (last point at or before, first at or after), chunk by chunk with the neighbouring chunks' end points carried over; no range join.
    """
    need = rows.where("p is not null").select(*by, "p").distinct().select(*by, "p", F.lit(None).cast("double").alias("fitted"))
    u = need.unionByName(curve.select(*by, "p", "fitted")).withColumn("chunk", block_of(F.col("p"), 1.0 / CHUNKS))
    u = u.withColumn("pt", F.when(F.col("fitted").isNotNull(), F.struct("p", "fitted")))
    u = carried(u, by, "chunk", {"m": F.max("pt")}, {"lo0": ("last", F.col("m"))})
    u = u.withColumn("back", -F.col("chunk"))
    u = carried(u, by, "back", {"m": F.min("pt")}, {"hi0": ("last", F.col("m"))})
    w = W.partitionBy(*by, "chunk").orderBy("p")
    u = u.withColumn("lo", F.coalesce(F.last("pt", True).over(w.rangeBetween(W.unboundedPreceding, 0)), "lo0")).withColumn("hi", F.coalesce(F.first("pt", True).over(w.rangeBetween(0, W.unboundedFollowing)), "hi0"))
    lo, hi = F.col("lo"), F.col("hi")
    mid = lo["fitted"] + (hi["fitted"] - lo["fitted"]) * (F.col("p") - lo["p"]) / (hi["p"] - lo["p"])
    val = F.when(lo.isNull(), hi["fitted"]).when(hi.isNull() | (hi["p"] == lo["p"]), lo["fitted"]).otherwise(mid)
    known = u.where("fitted is null").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("p").alias("__p"), val.alias("calibrated"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("p") == F.col("__p")]
    return rows.join(known, on, "left").drop("__p", *[f"__{c}" for c in by])
