"""Spikes, stuck values and impossible readings, judged per source by its own behaviour.

Per source (station and parameter) a robust autoregression of order two is fitted by trimmed least
squares. Its residuals go through iterative intervention tests: at each instant an *additive
outlier* (a patch of one to three readings that leaves the level unchanged) competes with a *level shift*
and with *transient changes* that fade. Each round the strongest effects are removed and the residuals
taken anew; rows are flagged where the additive outlier explains the residuals best. Readings beyond physical
limits and runs of one value are separated first and do not enter the fit. Rain is judged on a logarithmic scale.

Scale: rows are grouped by (source, block of days), each block with a margin of neighbouring rows (five days: the longest run that must be seen whole, 20 readings up
to six hours apart, fits), so no
series ever sits in one task as a whole and a hot source is spread over its blocks. The blocks are kept (one row each) and each source is
fitted once over all its blocks: sums of products by residual bucket are added up over blocks, trimmed and solved in rounds, the scale comes
from the same kind of buckets (relative error 1 %). The one row of coefficients per source then goes to its blocks. The rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import micros
from slotweave.runtime import cut

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Kind:
    """What is known of a parameter: physical range, values that are never at fault, scale and least run."""

    low: float = -np.inf
    high: float = np.inf
    never: tuple[float, ...] = ()
    log: bool = False
    spikes: bool = True
    run: int = 12
    small: float = 0.0  # values up to this repeat easily ...
    small_run: int = 12  # ... and need this many
    step: float = 0.1  # resolution of the sensor
    least: float = 0.0  # excursions smaller than this (on the scale judged) are weather


#: Parameters of the gauge network with their physical ranges.
KINDS = {
    "precip_past10min": Kind(0.0, 50.0, (-0.1, 0.0), log=True, small=0.35, small_run=15, least=1.6),
    "precip_past1min": Kind(0.0, 12.0, (-0.1, 0.0), log=True, small=0.35, small_run=20, least=1.6),
    "precip_dur_past10min": Kind(0.0, 10.0, (-0.1, 0.0, 10.0), spikes=False, step=1.0),
    "temp_dry": Kind(-40.0, 45.0, least=3.5),
    "temp_dew": Kind(-45.0, 35.0, least=3.5),
    "humidity": Kind(0.5, 100.5, step=0.25, least=8.0),
    "pressure": Kind(930.0, 1065.0, least=2.5),
    "wind_speed": Kind(0.0, 60.0, least=4.0),
}
CUT = 6.0
PATCH = 3
HORIZON = 10


def longest_runs(us: np.ndarray, v: np.ndarray, gap_us: float) -> np.ndarray:
    """For each reading the length of the run of its value (counted in instants).

    Of several deliveries for one instant the run goes on with any that has its value; a delivery with another
    value is in a run of its own.
    """
    n = len(v)
    if not n:
        return np.zeros(0, np.int64)
    first = np.r_[True, us[1:] != us[:-1]]
    if first.all():
        joined = v
    else:  # per instant the value that continues a neighbour's run, if there is one
        at = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], n]
        joined = v[ends - 1].copy()
        for k in np.flatnonzero(ends - starts > 1):
            own = v[starts[k] : ends[k]]
            near = [joined[k - 1]] if k else []
            if k + 1 < len(starts):
                near.append(v[starts[k + 1]])
            for x in near:
                if (own == x).any():
                    joined[k] = x
                    break
        us = us[starts]
    new = np.r_[True, (joined[1:] != joined[:-1]) | (np.diff(us) > gap_us)]
    run = np.cumsum(new) - 1
    length = np.bincount(run)[run]
    if first.all():
        return length
    return np.where(v == joined[at], length[at], 1)


def fit_ar2(y: np.ndarray, t: np.ndarray) -> tuple[float, float, float]:
    """Trimmed least squares of y on its two predecessors at the instants ``t``."""
    if len(t) < 30:
        return 0.0, 1.0, 0.0
    x = np.column_stack([np.ones(len(t)), y[t - 1], y[t - 2]])
    yt = y[t]
    r = yt - y[t - 1]
    c = np.array([0.0, 1.0, 0.0])
    for keep_at in (3.0, 3.0, 3.5):
        r = r - np.median(r)
        k = np.abs(r) <= keep_at * (1.4826 * np.median(np.abs(r)) + 1e-9)
        if k.sum() < 20:
            break
        xk = x[k]
        g = xk.T @ xk
        c = np.linalg.solve(g + 1e-9 * np.trace(g) * np.eye(3), xk.T @ yt[k])
        r = yt - x @ c
    return tuple(c)


def shapes_of(f1: float, f2: float, patch: int) -> tuple[list[tuple[str, int, np.ndarray]], np.ndarray]:
    """The interventions and, per column, their trace in the residuals of the autoregression."""
    ar = np.array([1.0, -f1, -f2])
    out = [("spike", k, np.ones(k)) for k in range(1, patch + 1)]
    out.append(("shift", 0, np.ones(HORIZON)))
    out += [("fade", 0, d ** np.arange(3 * HORIZON)) for d in (0.6, 0.8, 0.9)]
    trace = np.zeros((HORIZON, len(out)))
    for j, (what, _, effect) in enumerate(out):
        c = np.convolve(effect, ar)[:HORIZON]
        trace[: len(c), j] = c
    return out, trace


@dataclass(frozen=True)
class Fit:
    """What a source normally shows: step between readings, autoregression, scale of its residuals."""

    step: float
    c: tuple[float, float, float]
    sigma: float


def steps_of(us: np.ndarray, y: np.ndarray, kind: Kind, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Readings that have two near predecessors, and those of them that count for the fit."""
    near = np.r_[False, np.diff(us) <= 6 * max(step, 1)]
    ok = near & np.r_[False, near[:-1]]
    ok[:2] = False
    if not kind.log:
        return ok, ok
    # dry spells say nothing of the variation of rain
    return ok, np.r_[False, False, np.maximum(np.maximum(y[2:], y[1:-1]), y[:-2]) > 0.12] & ok


def scale_of(median: float, n: int, kind: Kind) -> float:
    """Scale from the median of absolute residuals over ``n`` steps."""
    sigma = max(1.4826 * median if n >= 10 else 0.0, 0.25 if kind.log else 0.5 * kind.step)
    # few wet steps may be there; a spike must not be among those that set its own measure
    return min(sigma, 0.35) if kind.log else sigma


def fit_series(us: np.ndarray, y: np.ndarray, kind: Kind) -> Fit:
    """The fit of one series held whole."""
    step = float(np.median(np.diff(us)))
    t = np.flatnonzero(steps_of(us, y, kind, step)[1])
    c = (0.0, 0.9, 0.0) if kind.log and len(t) < 30 else fit_ar2(y, t)
    e = np.abs(y[t] - c[0] - c[1] * y[t - 1] - c[2] * y[t - 2])
    return Fit(step, c, scale_of(float(np.median(e)) if len(t) else 0.0, len(t), kind))


def additive_outliers(us: np.ndarray, y: np.ndarray, kind: Kind, fit: Fit | None = None) -> np.ndarray:
    """Marks the readings of an ordered series that are additive outliers (patches of up to ``PATCH``).

    Without ``fit`` the series is held to be whole and fitted itself, from 12 readings on.
    """
    n = len(y)
    flags = np.zeros(n, bool)
    if n < (3 if fit else 12):
        return flags
    fit = fit or fit_series(us, y, kind)
    ok, moving = steps_of(us, y, kind, fit.step)
    (c0, f1, f2), sigma = fit.c, fit.sigma
    y = y.astype(float).copy()
    shapes, trace = shapes_of(f1, f2, 2 if kind.log else PATCH)
    n_spikes = sum(s[0] == "spike" for s in shapes)
    okp = np.r_[ok, np.zeros(HORIZON, bool)].astype(float)
    span = np.arange(HORIZON)
    for _ in range(n):  # each round removes something; so it ends
        e = np.zeros(n + HORIZON)
        e[2:n] = y[2:] - c0 - f1 * y[1:-1] - f2 * y[:-2]
        e[:n][~ok] = 0
        if kind.log:
            e[:n] = np.where(moving, e[:n], 0)
        at = np.flatnonzero(np.abs(e[:n]) > 0.6 * CUT * sigma)
        if not len(at):
            break
        win, seen = e[at[:, None] + span], okp[at[:, None] + span]
        dot, norm = win @ trace, np.maximum(seen @ trace**2, 1e-9)
        gain = dot * dot / norm
        gain[:, n_spikes] *= 1.0001  # a tie (nothing seen afterwards) is no spike
        best = np.argmax(gain, axis=1)
        pick = np.arange(len(at))
        top, size = gain[pick, best], (dot / norm)[pick, best]
        strong = np.sqrt(top) > CUT * sigma
        if not strong.any():
            break
        taken = np.zeros(n + 2 * HORIZON, bool)
        for i in np.argsort(-top, kind="stable"):
            if not strong[i]:
                break
            t, (what, length, effect) = at[i], shapes[best[i]]
            if taken[t : t + 2 * HORIZON].any():
                continue
            taken[t + HORIZON - 2 : t + HORIZON + 2] = True
            if what == "spike":
                end = min(t + length, n - 1)
                base = np.interp(np.arange(t, t + length), [t - 1, end], [y[t - 1], y[end]])
                off = y[t : t + length] - base
                top_off = np.abs(off).max()
                if top_off >= kind.least:
                    flags[t : t + length] |= (np.abs(off) >= max(0.4 * top_off, 0.6 * kind.least)) & (np.sign(off) == np.sign(size[i]))
                y[t : t + length] = base
            elif what == "shift":
                y[t:] -= size[i]
            else:
                m = min(len(effect), n - t)
                y[t : t + m] -= size[i] * effect[:m]
    return flags


def apart(us: np.ndarray, v: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(0 = left for the series, 1 = impossible, 2 = stuck; values that are never at fault) for readings ordered by time."""
    out = np.zeros(len(v), np.int8)
    never = np.zeros(len(v), bool)
    for x in kind.never:
        never |= np.abs(v - x) < 1e-4
    bad = ~never & ((v < kind.low) | (v > kind.high))
    out[bad] = 1
    rest = np.flatnonzero(~bad)
    run = longest_runs(us[rest], np.round(v[rest], 3), 6 * 3600e6)
    need = np.where(np.abs(v[rest]) <= kind.small, kind.small_run, kind.run)
    out[rest[(run >= need) & ~never[rest]]] = 2
    return out, never


def series(us: np.ndarray, v: np.ndarray, kind: Kind, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The readings left on the scale judged, and which of them stand in the series (of several for an instant the first)."""
    y = np.log1p(np.maximum(v[left], 0)) if kind.log else v[left]
    return y, np.r_[True, us[left][1:] != us[left][:-1]] if len(left) else np.zeros(0, bool)


def judge(us: np.ndarray, v: np.ndarray, kind: Kind, fit: Fit | None = None) -> np.ndarray:
    """0 = weather, 1 = impossible, 2 = stuck, 3 = spike for readings ordered by time."""
    out, never = apart(us, v, kind)
    left = np.flatnonzero(out == 0)
    if not kind.spikes or not len(left):
        return out
    y, first = series(us, v, kind, left)
    base = np.flatnonzero(first)
    bus, by = us[left][base], y[base]
    if fit is None and len(base) >= 12:
        fit = fit_series(bus, by, kind)
    hit = np.zeros(len(left), bool)
    hit[base] = additive_outliers(bus, by, kind, fit)
    owner = np.cumsum(first) - 1
    for k in np.flatnonzero(~first):  # further deliveries are held against the series, by the same fit
        i = owner[k]
        if abs(y[k] - by[i]) < 1e-6:
            hit[k] = hit[base[i]]
            continue
        lo, hi = max(0, i - 60), min(len(base), i + 60)
        lone = by[lo:hi].copy()
        lone[i - lo] = y[k]
        hit[k] = additive_outliers(bus[lo:hi], lone, kind, fit)[i - lo]
    out[left[hit & ~never[left]]] = 3
    return out


REASONS = ("", "impossible", "stuck", "spike")


#: Residual buckets: sign x (1 + number), each a hundredth about its middle; smaller ones are 0.
TINY, GROWTH = 1e-4, 1.02
SUMS = ("n", "x1", "x2", "x11", "x12", "x22", "z", "z1", "z2")
SOURCE = ("site", "parameter")
FITTED = ("step", "c0", "f1", "f2")


def bucket(r: np.ndarray) -> np.ndarray:
    k = np.floor(np.log(np.maximum(np.abs(r), TINY) / TINY) / np.log(GROWTH)).astype(np.int64) + 1
    return np.where(np.abs(r) < TINY, 0, np.sign(r).astype(np.int64) * k)


def middle(b: np.ndarray) -> np.ndarray:
    return np.sign(b) * np.where(b == 0, 0.0, TINY * GROWTH ** (np.abs(b) - 0.5))


def weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    o = np.argsort(x, kind="stable")
    c = np.cumsum(n[o])
    return float(x[o][np.searchsorted(c, 0.5 * c[-1])])


def solved(b: np.ndarray, sums: np.ndarray, c: tuple[float, float, float], keep_at: float) -> tuple[float, float, float]:
    """One round of trimmed least squares from the sums by residual bucket; as ``fit_ar2``."""
    r, n = middle(b), sums[:, 0]
    r = r - weighted_median(r, n)
    k = np.abs(r) <= keep_at * (1.4826 * weighted_median(np.abs(r), n) + 1e-9)
    n, x1, x2, x11, x12, x22, z, z1, z2 = sums[k].sum(axis=0)
    if sums[:, 0].sum() < 30 or n < 20:
        return c
    g = np.array([[n, x1, x2], [x1, x11, x12], [x2, x12, x22]])
    return tuple(np.linalg.solve(g + 1e-9 * np.trace(g) * np.eye(3), np.array([z, z1, z2])))


def fit_sources(blocks: DataFrame, kinds: dict[str, Kind], block: int) -> DataFrame:
    """``site, parameter, step, c0, f1, f2, sigma``: one row per source, from all its blocks."""
    fields = "site string, parameter string, step double, c0 double, f1 double, f2 double"

    def binned(fit: DataFrame | None) -> DataFrame:
        """Sums by bucket of the residuals; before there is a fit, readings by their distance in seconds from the one before."""
        unknown = fit is None

        def work(batches):
            for t in batches:
                for row in t.to_pylist():
                    us, y = np.frombuffer(row["bus"], np.int64), np.frombuffer(row["by"])
                    own = (us >= row["block"] * block) & (us < (row["block"] + 1) * block)
                    own[:1] = False
                    if unknown:
                        at = np.flatnonzero(own)
                        b, m, c = np.round((us[at] - us[at - 1]) / 1e6).astype(np.int64), np.zeros((len(at), len(SUMS))), (0.0, 0.0, 1.0, 0.0)
                        m[:, 0] = 1
                    else:
                        c = tuple(row[x] for x in FITTED)
                        at = np.flatnonzero(own & steps_of(us, y, kinds.get(row["parameter"], Kind()), c[0])[1]) if len(y) > 2 else np.zeros(0, np.int64)
                        z, p, q = y[at], y[at - 1], y[at - 2]
                        b = bucket(z - c[1] - c[2] * p - c[3] * q)
                        m = np.column_stack([np.ones(len(at)), p, q, p * p, p * q, q * q, z, p * z, q * z])
                    names, inv = np.unique(b, return_inverse=True)
                    if not len(names):  # a source without any step keeps its row
                        names, m, inv = np.zeros(1, np.int64), np.zeros((1, len(SUMS))), np.zeros(1, np.int64)
                    cols = [pa.array(np.bincount(inv, m[:, i], len(names))) for i in range(len(SUMS))]
                    same = [pa.array([x] * len(names), pa.string()) for x in (row["site"], row["parameter"])] + [pa.array([x] * len(names), pa.float64()) for x in c]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(names), *cols], [*SOURCE, *FITTED, "b", *SUMS])

        rows = blocks.select(*SOURCE, "block", "bus", "by")
        rows = rows if unknown else rows.join(F.broadcast(fit), list(SOURCE))
        out = rows.mapInArrow(work, fields + ", b long, " + ", ".join(f"{x} double" for x in SUMS))
        return out.groupBy(*SOURCE, *FITTED, "b").agg(*[F.sum(x).alias(x) for x in SUMS])

    def fitted(sums: DataFrame, stage: int) -> DataFrame:
        def work(t: pa.Table) -> pa.Table:
            kind = kinds.get(t.column("parameter")[0].as_py(), Kind())
            b, m = t.column("b").to_numpy(), np.column_stack([t.column(x).to_numpy() for x in SUMS])
            step, *c = (t.column(x)[0].as_py() for x in FITTED)
            n, sigma = m[:, 0].sum(), 0.0
            if stage == 0:
                step = weighted_median(b.astype(float), m[:, 0]) * 1e6 if n else 6e8
            elif stage <= 3:
                c = solved(b, m, tuple(c), (3.0, 3.0, 3.5)[stage - 1]) if n else c
                if kind.log and n < 30:
                    c = (0.0, 0.9, 0.0)
            else:
                sigma = scale_of(weighted_median(np.abs(middle(b)), m[:, 0]) if n else 0.0, n, kind)
            row = [step, *c] + ([sigma] if stage == 4 else [])
            return pa.table([t.column("site")[:1], t.column("parameter")[:1], *[pa.array([float(x)]) for x in row]], [*SOURCE, *FITTED, *(["sigma"] if stage == 4 else [])])

        return sums.groupBy(*SOURCE).applyInArrow(work, fields + (", sigma double" if stage == 4 else ""))

    fit = None
    for stage in range(5):
        fit = fitted(binned(fit), stage)
    return fit


def flag_faults(
    df: DataFrame, *, source: tuple[str, str] = ("station_id", "parameter_id"), ts: str = "observed_utc", value: str = "value", row_id: str = "obs_id", kinds: dict[str, Kind] | None = None, block_days: int = 64, margin_hours: int = 5 * 24
) -> DataFrame:
    """Faulty rows as ``row_id, reason`` (``impossible``, ``stuck`` or ``spike``), one row each.

    ``source`` names the site and the parameter; parameters without an entry in ``kinds`` have no physical limits.
    Rows with null or NaN value, or without source, time or id, are never cases. A second delivery is judged by
    its own value, with the fit of its source over all its rows. Empty input gives no rows.
    """
    kinds = KINDS if kinds is None else kinds
    block, margin = block_days * DAY_US, margin_hours * 3_600_000_000
    us = micros(ts)
    of = lambda x: F.floor(x / F.lit(block)).cast("int")
    rows = df.select(F.col(source[0]).alias("site"), F.col(source[1]).alias("parameter"), us.alias("us"), F.col(value).cast("float").alias("v"), F.col(row_id).cast("long").alias("id"))
    rows = rows.where("site is not null and parameter is not null and us is not null and v is not null and not isnan(v) and id is not null")
    rows = rows.withColumn("block", F.explode(F.array_distinct(F.array(of(F.col("us") - F.lit(margin)), of(F.col("us")), of(F.col("us") + F.lit(margin))))))

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        site, parameter, b = (x.as_py() for x in key)
        us, v, ids = t.column("us").to_numpy(), t.column("v").to_numpy().astype(float), t.column("id").to_numpy()
        o = np.lexsort((ids, us))
        us, v, ids = us[o], v[o], ids[o]
        kind = kinds.get(parameter, Kind())
        bus, by = us[:0], v[:0]
        core = (us >= b * block) & (us < (b + 1) * block)
        if kind.spikes and core.any():
            left = np.flatnonzero(apart(us, v, kind)[0] == 0)
            y, first = series(us, v, kind, left)
            bus, by = us[left][first], y[first]
        keep = [pa.array([x.tobytes()], pa.binary()) for x in (us, v, ids, bus, by)] if core.any() else [pa.array([], pa.binary())] * 5
        n = int(core.any())
        return pa.table([pa.array([site] * n, pa.string()), pa.array([parameter] * n, pa.string()), pa.array([b] * n, pa.int32()), *keep], ["site", "parameter", "block", "us", "v", "ids", "bus", "by"])

    blocks = cut(rows.groupBy("site", "parameter", "block").applyInArrow(gather, "site string, parameter string, block int, us binary, v binary, ids binary, bus binary, by binary"))

    def work(batches):
        for t in batches:
            for x in t.to_pylist():
                us, v, ids = np.frombuffer(x["us"], np.int64), np.frombuffer(x["v"]), np.frombuffer(x["ids"], np.int64)
                core = (us >= x["block"] * block) & (us < (x["block"] + 1) * block)
                r = judge(us, v, kinds.get(x["parameter"], Kind()), Fit(x["step"], (x["c0"], x["f1"], x["f2"]), x["sigma"]))
                k = np.flatnonzero(core & (r > 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array([REASONS[i] for i in r[k]], pa.string())], ["id", "reason"])

    fit = fit_sources(blocks, kinds, block)
    return blocks.join(F.broadcast(fit), list(SOURCE)).mapInArrow(work, "id long, reason string").withColumnRenamed("id", row_id)
