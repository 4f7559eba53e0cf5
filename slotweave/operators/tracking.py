"""Cells of point events around targets, instant by instant, without a frame of (target, event) pairs.

One event is near many targets, so a shuffle of pairs, and of the links between them, is many times the events. Here events and targets meet in bands of latitude per
instant; distances, cells, motion and arrivals of a band's targets are found together and only what a target sees comes out: one row with its cells.
Events are copied to the two bands at most that their reach touches. A task works through a band's targets, and through the links, in parts of at most ``PART`` numbers.
The numbers are those of ``lightning.around``, ``cells`` and ``motion``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions.geo import EARTH_KM
from slotweave.operators.lightning import EPS_KM, LEAST, MIN_US, REACH_KM, RECENT_MIN, SPAN_MIN, instants
from slotweave.operators.spatial import km_between

PART = 2_000_000
_REALS = ("clat", "clon", "spread_km", "age_min", "edge_km", "closing_kmh", "speed_kmh", "bearing", "ve", "vn", "confidence", "entry_min")
CELL = "cell: long, size: long, " + ", ".join(f"{c}: double" for c in _REALS)
SEEN = f"target string, at_us long, n_strikes long, near_km double, cells array<struct<{CELL}>>"
_CELL = pa.struct([("cell", pa.int64()), ("size", pa.int64()), *[(c, pa.float64()) for c in _REALS]])
_SEEN = pa.schema([("target", pa.string()), ("at_us", pa.int64()), ("n_strikes", pa.int64()), ("near_km", pa.float64()), ("cells", pa.list_(_CELL))])


def runs(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of entries that add up to ``most`` at most, or one entry."""
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def links(ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, km: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of events within ``km``, or of one id, part by part; ``ids`` rise."""
    s = np.argsort(lat, kind="stable")
    n = np.searchsorted(lat[s], lat[s] + math.degrees(km / EARTH_KM) * 1.000001, side="right") - np.arange(len(s)) - 1
    for a, b in runs(n, PART):
        k = n[a:b]
        i = np.repeat(np.arange(a, b), k)
        j = s[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)]
        i = s[i]
        ok = km_between(lat[i], lon[i], lat[j], lon[j]) <= km
        yield i[ok], j[ok]
    k = 1
    while k < len(ids) and len(same := np.flatnonzero(ids[k:] == ids[:-k])):
        yield same, same + k
        k += 1


def united(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels ``f`` (each entry's least entry) after the entries ``a`` and ``b`` are linked."""
    while True:
        lo, hi = np.minimum(f[a], f[b]), np.maximum(f[a], f[b])
        open_ = lo != hi
        if not open_.any():
            return f
        a, b = a[open_], b[open_]
        np.minimum.at(f, hi[open_], lo[open_])
        while not np.array_equal(g := f[f], f):
            f = g


def entries(e: np.ndarray, n: np.ndarray, ve: np.ndarray, vn: np.ndarray, km: float) -> np.ndarray:
    """``lightning.entry_min``, infinite where a point never enters."""
    a, b, c = ve * ve + vn * vn, 2 * (e * ve + n * vn), e * e + n * n - km * km
    disc = b * b - 4 * a * c
    root = np.sqrt(np.maximum(disc, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        lo, hi = (-b - root) / (2 * a), (-b + root) / (2 * a)
    return np.where(c <= 0, 0.0, np.where((a >= 1e-9) & (disc >= 0), np.where(lo >= 0, lo, np.where(hi >= 0, hi, np.inf)), np.inf))


def moved(at: int, t: np.ndarray, s: np.ndarray, km: np.ndarray, label: np.ndarray, ev: tuple[np.ndarray, ...], tlat: np.ndarray, tlon: np.ndarray, entry_km: float) -> tuple[np.ndarray, pa.StructArray]:
    """(target, cell) of every label: ``lightning.motion`` of its members, which lie together, in order of target and id."""
    ids, lat, lon, us = (x[s] for x in ev)
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    size = np.diff(np.r_[first, len(label)])
    mean, over = lambda x: np.add.reduceat(x, first) / size, lambda x: np.repeat(x, size)
    m = (us - at) / float(MIN_US)
    e, n = (lon - tlon[t]) * 111.320 * np.cos(np.radians(tlat[t])), (lat - tlat[t]) * 110.574
    clat, clon, ce, cn, last = mean(lat), mean(lon), mean(e), mean(n), np.maximum.reduceat(m, first)
    span = last - np.minimum.reduceat(m, first)
    fitted, used = (size >= 2) & (span > 0), (size >= 2) & (span >= SPAN_MIN)
    mt, me, mn = m - over(mean(m)), e - over(ce), n - over(cn)
    var = np.where(fitted, mean(mt * mt), 1.0)
    ve, vn = mean(mt * me) / var, mean(mt * mn) / var
    resid = np.sqrt(mean((me - over(ve) * mt) ** 2 + (mn - over(vn) * mt) ** 2))
    norm, speed = np.hypot(ce, cn), np.hypot(ve, vn)
    closing = np.where(used & (norm > 1e-6), -(ve * ce + vn * cn) / np.where(norm > 1e-6, norm, 1.0), 0.0)
    trust = np.minimum(1.0, size / (2.0 * LEAST)) * 0.4 + np.minimum(1.0, np.where(fitted, span, 0.0) / 10.0) * 0.3 + 0.3 / (1 + np.where(fitted, resid, 0.0) / 3.0)
    edge = np.minimum.reduceat(np.where(over(last) - m <= RECENT_MIN, km, np.inf), first)
    entry = np.minimum.reduceat(entries(e, n, over(np.where(used, ve, 0.0)), over(np.where(used, vn, 0.0)), entry_km), first)
    none = ~used
    cols = [
        (ids[first], None), (size.astype(np.int64), None), (clat, None), (clon, None), (mean(km_between(over(clat), over(clon), lat, lon)), None), (-last, None), (edge, None), (closing * 60, None), (speed * 60, none),
        (np.degrees(np.arctan2(ve, vn)) % 360.0, none | (speed <= 1e-6)), (ve, none), (vn, none), (trust, None), (entry, np.isinf(entry)),
    ]
    return t[first], pa.StructArray.from_arrays([pa.array(x, mask=mask) for x, mask in cols], fields=list(_CELL))


def seen(strikes: DataFrame, targets: DataFrame, *, stride_min: int, buffer_min: int, least: int = LEAST, reach_km: float = REACH_KM, eps_km: float = EPS_KM, entry_km: float = 10.0, few: bool = False) -> DataFrame:
    """``SEEN``: one row per target and instant with ``least`` events in reach or more: their number, the nearest's distance and the cells (``lightning.motion``'s columns, and the minutes until a
    member enters the ring ``entry_km``). With ``few`` also those with fewer events, without cells.

    ``strikes``: ``id, lat, lon, us``; ``targets``: ``target, lat, lon``, one row each. Rows with nulls or NaN match nothing.
    """
    reach = math.degrees(reach_km / EARTH_KM) * 1.000001
    band = lambda lat: F.floor(lat / F.lit(4 * reach)).cast("long")
    usable = lambda df, key: df.where(f"{key} is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    near = usable(strikes, "id").where("us is not null").select(F.col("id").cast("long").alias("id"), "lat", "lon", "us")
    near = near.withColumn("band", F.explode(F.sequence(band(F.col("lat") - F.lit(reach)), band(F.col("lat") + F.lit(reach))))).withColumn("at_us", F.explode(instants(F.col("us"), stride_min, buffer_min)))
    # few bytes, much work: the number of partitions is kept
    near = near.repartition(int(strikes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at_us", "band")
    there = usable(targets, "target").select(F.col("target").cast("string").alias("target"), "lat", "lon", band(F.col("lat")).alias("band"))
    there = near.select("at_us", "band").distinct().join(there, "band").select(F.col("at_us").alias("at"), F.col("band").alias("zone"), "target", "lat", "lon")

    def part(at: int, ev: tuple[np.ndarray, ...], names: pa.Array, tlat: np.ndarray, tlon: np.ndarray) -> pa.Table:
        d = km_between(tlat[:, None], tlon[:, None], ev[1][None, :], ev[2][None, :])
        inside = d <= reach_km
        n = inside.sum(1)
        many = n >= least
        row = np.cumsum(inside.ravel()).reshape(inside.shape) - 1
        t, s = np.nonzero(inside)
        f, big = np.arange(len(t)), inside & many[:, None]
        for i, j in links(*ev[:3], eps_km) if many.any() else ():
            for a, b in runs(np.full(len(i), len(tlat)), PART):
                k, l = np.nonzero(big[:, i[a:b]] & big[:, j[a:b]])  # noqa: E741
                f = united(f, row[k, i[a:b][l]], row[k, j[a:b][l]])
        keep = np.flatnonzero(many[t])
        keep = keep[np.argsort(f[keep], kind="stable")]
        out = np.flatnonzero(n if few else many)
        nearest = np.where(inside, d, np.inf).min(1)[out]
        of, cells = moved(at, t[keep], s[keep], d[t[keep], s[keep]], f[keep], ev, tlat, tlon, entry_km) if len(keep) else (np.zeros(0, np.int64), pa.array([], _CELL))
        ends = np.cumsum(np.bincount(of, minlength=len(tlat))[out])
        return pa.table([names.take(pa.array(out)), pa.array(np.full(len(out), at)), pa.array(n[out]), pa.array(nearest), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), cells)], schema=_SEEN)

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _SEEN.empty_table()
        ev = tuple(left.column(c).to_numpy() for c in ("id", "lat", "lon", "us"))
        o = np.lexsort((ev[3], ev[2], ev[1], ev[0]))
        ev = tuple(x[o] for x in ev)
        names, tlat, tlon = right.column("target").combine_chunks(), right.column("lat").to_numpy(), right.column("lon").to_numpy()
        step = max(1, PART // left.num_rows)
        return pa.concat_tables([part(key[0].as_py(), ev, names.slice(k, step), tlat[k : k + step], tlon[k : k + step]) for k in range(0, right.num_rows, step)])

    return near.groupBy("at_us", "band").cogroup(there.groupBy("at", "zone")).applyInArrow(work, SEEN)
