"""Ensembles and grids in long form: probabilities within a lead, arrival times, block percentiles, neighbourhood scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.operators.verification import ratio


def steps_in_lead(lead_min: Column, age_min: Column, step_min: float, n_steps: int) -> Column:
    """Steps a lead covers, counted from a frame of that age: up to the next whole step, within the horizon."""
    return F.greatest(F.lit(1), F.least(F.ceil((lead_min + F.greatest(age_min, F.lit(0.0))) / F.lit(step_min) - 1e-9).cast("int"), F.lit(n_steps)))


def ensemble_products(cells: DataFrame, *, members: str, n_steps: int, leads: dict[int, int], threshold: float, step_min: int) -> DataFrame:
    """Adds per cell ``p_<lead>``, ``eta_min`` and ``intensity``.

    ``members`` is an array (member) of arrays (step) of rates. The probability is the share of members that reach the threshold within
    the lead's steps; the ETA is the first step by which half of them have; the intensity is the median of the first step. Higher-order functions: no
    explosion, no shuffle. NaN is no rain.
    """
    reach = lambda m: F.coalesce(F.array_position(F.transform(m, lambda x: (x >= F.lit(threshold)) & ~F.isnan(x)), True), F.lit(0))
    out = cells.withColumn("__first", F.transform(F.col(members), reach)).withColumn("__n", F.size(members))
    by = lambda k: F.size(F.filter("__first", lambda f: (f > 0) & (f <= F.lit(k)))) / F.col("__n")
    out = out.withColumns({f"p_{lead}": by(k) for lead, k in leads.items()})
    eta = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(n_steps)), lambda k: F.size(F.filter("__first", lambda f: (f > 0) & (f <= k))) * 2 >= F.col("__n")))
    s = F.array_sort(F.transform(F.col(members), lambda m: F.get(m, F.lit(0)).cast("double")))
    n = F.col("__n")
    med = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return out.withColumns({"eta_min": eta * F.lit(step_min), "intensity": med}).drop("__first", "__n")


def block_percentile(grid: DataFrame, by: list[str], size: int, value: str, q: float = 0.9) -> DataFrame:
    """A percentile (linear) of every ``size`` x ``size`` block, NaN and null left out."""
    ok = F.when(~F.isnan(F.col(value)), F.col(value))
    return grid.groupBy(*by, F.floor(F.col("row") / size).cast("int").alias("brow"), F.floor(F.col("col") / size).cast("int").alias("bcol")).agg(F.percentile(ok, F.lit(q)).alias("v"), F.count(ok).alias("n"))


def fractions_skill(grid: DataFrame, by: list[str], pred: Column, actual: Column, radius: int) -> DataFrame:
    """``mse, ref, fss`` per grid: shares of cells over the threshold in a square neighbourhood of each.

    Two window sums (along rows, then along columns) instead of a neighbourhood join; cells beyond the border count as dry.
    """
    side = float((2 * radius + 1) ** 2)
    g = grid.select(*by, "row", "col", pred.cast("int").alias("f"), actual.cast("int").alias("o"))
    wr = W.partitionBy(*by, "row").orderBy("col").rangeBetween(-radius, radius)
    wc = W.partitionBy(*by, "col").orderBy("row").rangeBetween(-radius, radius)
    g = g.withColumns({"f1": F.sum("f").over(wr), "o1": F.sum("o").over(wr)})
    g = g.withColumns({"pf": F.sum("f1").over(wc) / side, "po": F.sum("o1").over(wc) / side})
    r = g.groupBy(*by).agg(F.avg(F.pow(F.col("pf") - F.col("po"), 2)).alias("mse"), F.avg(F.pow("pf", 2) + F.pow("po", 2)).alias("ref"))
    return r.withColumn("fss", 1 - ratio(F.col("mse"), F.col("ref")))


def disc_statistics(grid: DataFrame, centres: DataFrame, radius: int, value: str) -> DataFrame:
    """Max, mean, 90th percentile and number of cells within ``radius`` of each centre (``id, row, col``): offsets meet cells by an equi-join."""
    offs = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    near = centres.select("id", F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in offs])).alias("c")).select("id", "c.row", "c.col")
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    return near.join(grid, ["row", "col"]).groupBy("id").agg(F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.percentile(v, F.lit(0.9)).alias("v_p90"), F.count(v).alias("n"))


def divergence(grid: DataFrame, by: list[str], vx: str, vy: str) -> DataFrame:
    """Mean absolute divergence of a motion field by central differences (inner cells)."""
    wr, wc = W.partitionBy(*by, "row").orderBy("col"), W.partitionBy(*by, "col").orderBy("row")
    dx = (F.lead(vx).over(wr) - F.lag(vx).over(wr)) / 2
    dy = (F.lead(vy).over(wc) - F.lag(vy).over(wc)) / 2
    return grid.withColumn("d", F.abs(dx + dy)).groupBy(*by).agg(F.avg("d").alias("divergence"), F.count("d").alias("n"))


def array_quantile(sorted_: Column, q: float) -> Column:
    """Quantile (linear) of a sorted array; null for an empty one."""
    pos = F.lit(float(q)) * (F.size(sorted_) - 1)
    lo, hi = F.get(sorted_, F.floor(pos).cast("int")), F.get(sorted_, F.ceil(pos).cast("int"))
    return F.when(F.size(sorted_) > 0, lo + (pos - F.floor(pos)) * (hi - lo))


def ensemble_features(cells: DataFrame, *, members: str, leads: dict[int, int], threshold: float, step_min: int, least: int) -> DataFrame:
    """Adds ``mean_<lead>`` and ``p90_<lead>`` of the members' greatest rate by the lead, ``n_arrive`` and ``eta_spread`` (p75 - p25 of arrivals, if ``least`` arrive)."""
    top = lambda k: F.array_sort(F.transform(members, lambda m: F.array_max(F.slice(m, 1, k)).cast("double")))
    out = cells
    for lead, k in leads.items():
        s = top(k)
        out = out.withColumns({f"mean_{lead}": F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s), f"p90_{lead}": array_quantile(s, 0.9)})
    first = F.transform(members, lambda m: F.coalesce(F.array_position(F.transform(m, lambda x: x >= F.lit(threshold)), True), F.lit(0)).cast("double"))
    arr = F.array_sort(F.filter(first, lambda k: k > 0))
    spread = (array_quantile(arr, 0.75) - array_quantile(arr, 0.25)) * F.lit(step_min)
    return out.withColumns({"n_arrive": F.size(arr).cast("long"), "eta_spread": F.when(F.size(arr) >= least, spread)})


def disc_members(grid: DataFrame, centres: DataFrame, *, radius: int, members: str, n_members: int, n_steps: int) -> DataFrame:
    """``id, members``: per centre the greatest rate of each member and step within ``radius``: offsets meet cells by an equi-join, maxima per element with map-side combine."""
    offs = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    near = centres.select("id", F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in offs])).alias("c")).select("id", "c.row", "c.col")
    met = near.join(grid.select("row", "col", members), ["row", "col"])
    top = met.groupBy("id").agg(*[F.max(F.get(F.get(members, F.lit(m)), F.lit(k))).alias(f"x{m}_{k}") for m in range(n_members) for k in range(n_steps)])
    return top.select("id", F.array(*[F.array(*[F.col(f"x{m}_{k}") for k in range(n_steps)]) for m in range(n_members)]).alias("members"))
