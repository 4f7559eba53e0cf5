"""Models and allocations against numpy and plain loops, and at their edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.operators import models as M
from slotweave.operators import harmonise, sampling


def newton(x, y, w, l2):
    x = np.column_stack([np.ones(len(x)), x])
    pen, b = l2 * np.r_[0.0, np.ones(x.shape[1] - 1)], np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + np.diag(pen), x.T @ (w * (y - mu)) - pen * b)
    return b


def test_logistic_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0, 0.0])))).astype(float)
    w, fold = rng.random(600) + 0.5, np.arange(600) % 4
    df = spark.createDataFrame([(*map(float, r), float(a), float(b), int(k)) for r, a, b, k in zip(x, y, w, fold)], "a double, b double, c double, y double, w double, fold int")
    got = M.fit_logistic(df, ["a", "b", "c"], y="y", w="w", l2=2.0)
    for k in range(4):
        assert np.allclose(got[k], newton(x[fold != k], y[fold != k], w[fold != k], 2.0), atol=1e-6)
    q = {round(r.a, 9): r.q for r in M.predict_logistic(df, ["a", "b", "c"], got).collect()}
    assert all(abs(q[round(float(r[0]), 9)] - 1 / (1 + math.exp(-(got[k][0] + r @ got[k][1:])))) < 1e-9 for r, k in zip(x, fold))


def plain(model, row):
    out = model["base"]
    for t in model["trees"]:
        n = 0
        while t["feature"][n] >= 0:
            v = row[t["feature"][n]]
            left = t["default_left"][n] if v is None or not math.isfinite(v) else v <= t["threshold"][n]
            n = t["left"][n] if left else t["right"][n]
        out += t["value"][n]
    return out


def test_trees_equal_plain_recursion(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, float("nan"), rng.random()]), rng.random() * 60, 0.0) for i in range(500)]
    rows = [(i, a, b, float(rng.random() < (0.8 if (a or 0) > 0.5 or b < 10 else 0.2))) for i, a, b, _ in rows]
    df = spark.createDataFrame(rows, "i int, a double, b double, y double")
    m = M.load(M.dump(M.fit_trees(df, ["a", "b"], y="y", trees=3, depth=3)))
    assert len(m["trees"]) == 3 and max(len(t["value"]) for t in m["trees"]) > 3
    got = {r.i: r.raw for r in M.raw_score(df, m).collect()}
    assert all(abs(got[i] - plain(m, (a, b))) < 1e-9 for i, a, b, _ in rows)
    p = np.array([1 / (1 + math.exp(-got[i])) for i, *_ in rows])
    y = np.array([r[3] for r in rows])
    assert np.mean((p - y) ** 2) < 0.9 * np.mean((y.mean() - y) ** 2)
    assert M.fit_trees(df.where("false"), ["a", "b"], y="y")["trees"] == [] and M.raw_score(df.where("false"), m).count() == 0
    with pytest.raises(ValueError):
        M.load(M.dump({**m, "trees": [{**m["trees"][0], "left": [99] * len(m["trees"][0]["left"])}]}))


def deal(sizes, total, floor):
    take = {}
    for k in sorted(sizes):
        take[k] = min(floor, sizes[k], total - sum(take.values()))
    rest = total - sum(take.values())
    room = {k: sizes[k] - take[k] for k in sizes}
    free = sum(room.values())
    share = min(rest, free)
    if share > 0:
        quota = {k: share * room[k] / free for k in sizes}
        base = {k: math.floor(q) for k, q in quota.items()}
        for k in sorted(sizes, key=lambda k: (-round(quota[k] - math.floor(quota[k]), 9), k))[: share - sum(base.values())]:
            base[k] += 1
        take = {k: take[k] + base[k] for k in take}
    return take


@pytest.mark.parametrize(("total", "floor"), [(0, 3), (7, 5), (60, 0), (60, 4), (1000, 2)])
def test_places_are_dealt_as_by_hand(spark, total, floor):
    rng = random.Random(total)
    sizes = {f"c{i:02}": rng.choice([0, 1, 2, 9, 40]) for i in range(17)}
    got = {r.c: r.seats for r in sampling.allocate(spark.createDataFrame(list(sizes.items()), "c string, n long"), "c", "n", total=total, floor=floor).collect()}
    assert got == deal(sizes, total, floor) and sum(got.values()) == min(total, sum(sizes.values())) and all(got[k] <= sizes[k] for k in sizes)


def test_curves_interpolate_and_clamp(spark):
    d = spark.createDataFrame([(p, [0.2, 0.4], [0.1, 0.5]) for p in (0.0, 0.2, 0.3, 0.4, 0.9, None)] + [(0.5, None, None)], "p double, xs array<double>, ys array<double>")
    got = [r[0] for r in d.select(M.interpolated(F.col("p"), F.col("xs"), F.col("ys"))).collect()]
    assert got[5] is None and got[6] is None and np.allclose(got[:5], [0.1, 0.1, 0.3, 0.5, 0.5])


def test_binned_curve_of_few_and_equal_values(spark):
    d = spark.createDataFrame([("a", 0.5, 1.0)] * 3 + [("a", 0.5, 0.0)] + [("b", None, 1.0), ("b", 0.1, None)], "g string, p double, y double")
    got = {r.g: (r.xs, r.ys) for r in M.binned_curves(d, ["g"], bins=4).collect()}
    assert got == {"a": ([0.5], [0.75])}


def test_quantile_maps_keep_the_share_above(spark):
    rng = np.random.default_rng(5)
    a, b = rng.gamma(1.5, 2.0, 4000), rng.gamma(2.5, 1.0, 4000)
    df = spark.createDataFrame([("s", float(x), float(y)) for x, y in zip(a, b)] + [("s", None, float("nan")), (None, 1.0, 2.0)], "g string, a double, b double")
    h = harmonise.histogram(df, ["g"], ["a", "b"], 0.0, 0.25, 60)
    assert h.where("g = 's'").agg(F.sum("a"), F.sum("b")).first()[:] == (4000, 4000)
    m = {r.g: (np.array(r.xs), np.array(r.ys)) for r in harmonise.fit_maps(h, ["g"], "a", "b", 0.0, 0.25, 60).collect()}
    xs, ys = m["s"]
    moved = np.interp(a, xs, ys)
    assert (np.diff(ys) >= 0).all() and all(abs((moved >= t).mean() - (b >= t).mean()) < 0.02 for t in (0.5, 1.0, 2.0, 4.0))
    assert np.array_equal(m[None][0], m[None][1])  # too few: nothing is changed
    assert harmonise.fit_maps(h.where("false"), ["g"], "a", "b", 0.0, 0.25, 60).count() == 0
