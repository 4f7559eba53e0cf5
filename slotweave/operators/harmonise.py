"""One product's values brought onto another's distribution: quantile maps from two histograms over the same rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.operators.models import interpolated


def histogram(df: DataFrame, by: Sequence[str], columns: Sequence[str], low: float, width: float, bins: int) -> DataFrame:
    """``by, bin, <column>...``: counts per column over the same bins; values beyond the ends count in the end bins, null and NaN ones nowhere."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns]))
    d = df.select(*by, one.alias("v")).select(*by, "v.*").where("x is not null and not isnan(x)")
    b = F.greatest(F.lit(0), F.least(F.floor((F.col("x") - low) / width).cast("int"), F.lit(bins - 1)))
    return d.groupBy(*by, b.alias("bin")).agg(*[F.count_if(F.col("c") == c).alias(c) for c in columns])


def quantile_map(a: np.ndarray, b: np.ndarray, edges: np.ndarray, least: float) -> np.ndarray:
    """For each lower edge the value of the second product with the first one's exceedance; beyond the last edge at which both tails hold ``least`` the offset there is kept; never falling."""
    tail_a, tail_b = np.cumsum(a[::-1])[::-1], np.cumsum(b[::-1])[::-1]
    if not tail_a[0] or not tail_b[0]:
        return edges.copy()
    fa, fb = tail_a / tail_a[0], tail_b / tail_b[0]
    out = np.interp(fa, fb[::-1], edges[::-1])
    firm = np.flatnonzero((tail_a >= least) & (tail_b >= least))
    if not len(firm):
        return edges.copy()
    last = firm[-1]
    out[last + 1 :] = edges[last + 1 :] + out[last] - edges[last]
    return np.maximum.accumulate(out)


def fit_maps(hist: DataFrame, by: Sequence[str], a: str, b: str, low: float, width: float, bins: int, least: float = 50) -> DataFrame:
    """``by, xs, ys``: the map from ``a`` to ``b`` per group; a group is one histogram of ``bins`` numbers."""
    edges = low + width * np.arange(bins)
    names = "".join(f"`{c}` {hist.schema[c].dataType.simpleString()}, " for c in by)

    def work(key: tuple, t: pa.Table) -> pa.Table:
        x, y = np.zeros(bins), np.zeros(bins)
        at = t.column("bin").to_numpy()
        x[at], y[at] = t.column(a).to_numpy(), t.column(b).to_numpy()
        kind = pa.list_(pa.float64())
        return pa.table({**{c: pa.array([k.as_py()], t.schema.field(c).type) for c, k in zip(by, key)}, "xs": pa.array([edges.tolist()], kind), "ys": pa.array([quantile_map(x, y, edges, least).tolist()], kind)})

    return hist.groupBy(*by).applyInArrow(work, names + "xs array<double>, ys array<double>")


def mapped(value: Column, xs: Column, ys: Column, least: float) -> Column:
    """The value by the map; values below ``least``, NaN and groups without a map stay as they are."""
    return F.when(F.isnan(value) | (value < least) | xs.isNull(), value).otherwise(interpolated(value, xs, ys))
