"""Models fitted by aggregates: ridge logistic regression by distributed Newton steps, isotonic curves over quantile bins, boosted trees by histograms.

A step sums small products over all rows (map-side combine) and solves a system of a few numbers; only those sums reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.operators.calibration import pool_violators
from slotweave.operators.verification import finite, quantiles
from slotweave.runtime import cut


def folds_of(df: DataFrame, unit: Column, n: int, seed: int = 0) -> DataFrame:
    """Adds ``fold``: whole units (days, say) dealt to ``n`` folds by a fixed hash."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), unit), F.lit(n)).cast("int"))


def fit_logistic(df: DataFrame, features: Sequence[str], *, y: str, w: str, fold: str = "fold", l2: float = 1.0, rounds: int = 12, tol: float = 1e-9) -> dict[int, np.ndarray]:
    """Coefficients (intercept first, not penalised) per fold, each fitted on the rows of all *other* folds.

    All folds are fitted together: in a step every task sums gradient and curvature of its rows at every fold's coefficients. Features must be
    finite (see ``standardise``). Folds times features squared numbers reach the driver.
    """
    p = len(features) + 1
    names = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    beta = {k: np.zeros(p) for k in names}
    rows = df.select(F.col(fold).cast("int").alias("k"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    cells = [f"g{i}" for i in range(p)] + [f"h{i}_{j}" for i in range(p) for j in range(p)]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(p + p * p) for k in names}
            for b in batches:
                own, t, u = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "y", "w"))
                x = np.column_stack([np.ones(b.num_rows), *[b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p - 1)]])
                for k in names:  # every fold's model sees the rows of the other folds
                    m = own != k
                    z = x[m]
                    mu = 1 / (1 + np.exp(-(z @ beta[k])))
                    h = (z * (u[m] * mu * (1 - mu))[:, None]).T @ z
                    total[k] += np.r_[z.T @ (u[m] * (t[m] - mu)), h.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array([total[k][i] for k in names]) for i in range(p + p * p)]], ["fold", *cells])

        got = {r["fold"]: r for r in rows.mapInArrow(sums, "fold int, " + ", ".join(f"{c} double" for c in cells)).groupBy("fold").agg(*[F.sum(c).alias(c) for c in cells]).collect()}
        moved = 0.0
        for k in names:
            v = np.array([got[k][c] for c in cells])
            pen = l2 * np.r_[0.0, np.ones(p - 1)]
            step = np.linalg.solve(v[p:].reshape(p, p) + np.diag(pen + 1e-9), v[:p] - pen * beta[k])
            beta[k] = beta[k] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return beta


def predict_logistic(df: DataFrame, features: Sequence[str], beta: dict[int, np.ndarray], fold: str = "fold") -> DataFrame:
    """Adds ``q``: each row by the model of its own fold, which never saw it."""
    def eta(b: np.ndarray) -> Column:
        return sum((F.col(c).cast("double") * float(v) for c, v in zip(features, b[1:])), F.lit(float(b[0])))

    out = F.lit(None).cast("double")
    for k, b in beta.items():
        out = F.when(F.col(fold) == F.lit(k), 1 / (1 + F.exp(-eta(b)))).otherwise(out)
    return df.withColumn("q", out)


def binned_curves(df: DataFrame, by: Sequence[str], *, p: str = "p", y: str = "y", bins: int = 20, least: int = 1) -> DataFrame:
    """``by, xs, ys``: isotonic curve over quantile bins per group (sorted arrays of at most ``bins`` points); groups of fewer than ``least`` rows have none.

    Bins end at distinct quantiles, hold their means and count as many as their rows; a group in one bin has the same value everywhere.
    """
    q = quantiles(df.where(F.col(y).isNotNull()), by, p, [k / bins for k in range(bins + 1)], 1.0 / 1024).where(F.col("n") >= least)
    edges = q.select(*[F.col(c).alias(f"__{c}") for c in by], F.array_distinct(F.array(*[f"q{k}" for k in range(bins + 1)])).alias("edges"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    j = df.where(finite(F.col(p)) & F.col(y).isNotNull()).select(*by, F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")).join(F.broadcast(edges) if not by else edges, on if by else None)
    bin_ = F.greatest(F.lit(0), F.least(F.size(F.filter("edges", lambda e: e <= F.col("p"))) - 1, F.size("edges") - 2))
    g = j.groupBy(*by, bin_.alias("bin")).agg(F.avg("p").alias("x"), F.avg("y").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = g.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "m", "n"))).alias("b"))  # at most ``bins`` entries

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            xs, ys = [], []
            for b in t.column("b").to_pylist():
                x, m, n = (np.array([r[k] for r in b]) for k in ("x", "m", "n"))
                xs.append(x.tolist())
                ys.append(pool_violators(m, n).tolist())
            yield pa.RecordBatch.from_arrays([*[t.column(c) for c in by], pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.float64()))], [*by, "xs", "ys"])

    names = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return rows.mapInArrow(fit, names + "xs array<double>, ys array<double>")


def interpolated(p: Column, xs: Column, ys: Column) -> Column:
    """Linear between the points of sorted arrays, clamped at the ends; null without a curve."""
    k = F.size(F.filter(xs, lambda x: x <= p))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return F.when(xs.isNull() | p.isNull(), F.lit(None)).when(k == 0, F.get(ys, F.lit(0))).when(k == F.size(xs), F.get(ys, k - 1)).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0))


#: A tree as flat lists: feature (-1: leaf), threshold (left if value <= it), children, where missing values go, leaf values.
TREE = ("feature", "threshold", "left", "right", "default_left", "value")


def fit_trees(df: DataFrame, features: Sequence[str], *, y: str, trees: int = 4, depth: int = 2, rate: float = 0.3, bins: int = 16, least: int = 20, l2: float = 1.0) -> dict:
    """Boosted trees for a 0/1 target by gradient histograms: ``{"base": ..., "features": [...], "trees": [...]}``.

    Cuts are tried at quantiles; each level of a tree is one pass that sums gradient and curvature per (node, feature, bin), missing values apart and tried on both sides. Only these
    histograms reach the driver.
    """
    edges = {}
    for c in features:
        row = quantiles(df, [], c, [k / bins for k in range(1, bins)], 1.0).first()
        edges[c] = sorted({float(row[f"q{k}"]) for k in range(bins - 1)}) if row else []
    base = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    if base is None:
        return {"base": 0.0, "features": list(features), "trees": []}
    base = float(np.log(np.clip(base, 1e-6, 1 - 1e-6) / (1 - np.clip(base, 1e-6, 1 - 1e-6))))
    model = {"base": base, "features": list(features), "trees": []}
    missing = lambda c: ~finite(F.col(c))

    def bin_of(c: str) -> Column:
        out = F.lit(0)
        for e in edges[c]:
            out = out + F.when(F.col(c) > e, 1).otherwise(0)
        return F.when(missing(c), -1).otherwise(out)

    for _ in range(trees):
        t = {k: [] for k in TREE}

        def add(t: dict, value: float) -> int:
            for k, v in zip(TREE, (-1, 0.0, -1, -1, True, value)):
                t[k].append(v)
            return len(t["value"]) - 1

        add(t, 0.0)
        score = cut(raw_score(df.select(y, *features), model))
        for _ in range(depth + 1):
            leaf = leaf_of(t, features)
            mu = 1 / (1 + F.exp(-F.col("raw")))
            d = score.select(leaf.alias("node"), (F.col(y).cast("double") - mu).alias("g"), (mu * (1 - mu)).alias("h"), F.explode(F.array(*[F.struct(F.lit(i).alias("f"), bin_of(c).alias("b")) for i, c in enumerate(features)])).alias("x"))
            sums = d.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).collect()  # nodes x features x bins
            last = len(t["value"])
            for node in range(last):
                mine = [r for r in sums if r["node"] == node]
                if not mine or t["feature"][node] >= 0:
                    continue
                one = [r for r in mine if r["f"] == 0]
                gt, ht = sum(r["g"] for r in one), sum(r["h"] for r in one)
                t["value"][node] = rate * gt / (ht + l2)
                best = None
                for i, c in enumerate(features):
                    cells = {r["b"]: (r["g"], r["h"], r["n"]) for r in mine if r["f"] == i}
                    lost = cells.pop(-1, (0.0, 0.0, 0))
                    for k, e in enumerate(edges[c]):
                        a = np.sum([v for b, v in cells.items() if b <= k] or [(0, 0, 0)], axis=0)
                        z = np.sum([v for b, v in cells.items() if b > k] or [(0, 0, 0)], axis=0)
                        for left in (True, False):
                            u, v = (a + lost, z) if left else (a, z + lost)
                            if u[2] >= least and v[2] >= least:
                                gain = u[0] ** 2 / (u[1] + l2) + v[0] ** 2 / (v[1] + l2) - gt**2 / (ht + l2)
                                if best is None or gain > best[0] + 1e-12:
                                    best = (gain, i, e, left)
                if best and best[0] > 1e-9 and depth_of(t, node) < depth:
                    t["feature"][node], t["threshold"][node], t["default_left"][node] = best[1], best[2], best[3]
                    t["left"][node] = add(t, 0.0)
                    t["right"][node] = add(t, 0.0)
        model["trees"].append(t)
    return model


def depth_of(t: dict, node: int) -> int:
    d = 0
    while node:
        node = next(i for i in range(len(t["value"])) if node in (t["left"][i], t["right"][i]))
        d += 1
    return d


def leaf_of(t: dict, features: Sequence[str], node: int = 0) -> Column:
    """The number of the leaf a row falls in, as nested conditions."""
    if t["feature"][node] < 0:
        return F.lit(node)
    x = F.col(features[t["feature"][node]])
    left = F.when(~finite(x), F.lit(bool(t["default_left"][node]))).otherwise(x <= float(t["threshold"][node]))
    return F.when(left, leaf_of(t, features, t["left"][node])).otherwise(leaf_of(t, features, t["right"][node]))


def walk(model: dict, x: np.ndarray) -> np.ndarray:
    """Sum of leaf values over all trees plus the base for the rows of ``x``; all rows go down a level at once."""
    out = np.full(len(x), float(model["base"]))
    for t in model["trees"]:
        feature, threshold, left, right, default, value = (np.asarray(t[k]) for k in TREE)
        node = np.zeros(len(x), np.int64)
        live = np.flatnonzero(feature[node] >= 0)
        while len(live):
            at = node[live]
            v = x[live, feature[at]]
            bad = ~np.isfinite(v)
            node[live] = np.where(np.where(bad, default[at].astype(bool), v <= threshold[at]), left[at], right[at])
            live = live[feature[node[live]] >= 0]
        out += value[node]
    return out


def raw_score(df: DataFrame, model: dict) -> DataFrame:
    """Adds ``raw``: the trees' score of every row, batch by batch in numpy; missing features are null, NaN or infinite."""
    features = model["features"]
    schema = T.StructType([*df.schema.fields, T.StructField("raw", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features]) if b.num_rows else np.zeros((0, len(features)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(walk(model, x))], [*b.schema.names, "raw"])

    return df.mapInArrow(work, schema)


def dump(model: dict) -> str:
    return json.dumps(model)


def load(text: str) -> dict:
    """A dumped model; raises if lists of a tree differ in length or children lie outside it."""
    m = json.loads(text)
    for t in m["trees"]:
        n = len(t["value"])
        if any(len(t[k]) != n for k in TREE) or any(not (0 <= c < n) for k in ("left", "right") for c, f in zip(t[k], t["feature"]) if f >= 0):
            raise ValueError("not a tree")
    return m
