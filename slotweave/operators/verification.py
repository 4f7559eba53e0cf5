"""Verification aggregates: reliability, Brier and its parts, skill scores, ranking metrics, ensembles.

All rates come from pooled counts. Everything is a partial/final aggregate; ranking metrics are taken over distinct scores
(counts per score first), so a window runs over distinct values and not over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.operators.blocks import block_of, running_sums


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def valid_forecasts(df: DataFrame, prob: str = "raw_prob", outcome: str = "outcome", weight: str = "sample_weight") -> DataFrame:
    """Rows fit for scoring, with ``p``, ``y`` and ``w`` as doubles: finite probability, known outcome, finite positive weight."""
    ok = finite(F.col(prob)) & F.col(outcome).isNotNull() & finite(F.col(weight)) & (F.col(weight) > 0)
    return df.where(ok).withColumns({"p": F.col(prob).cast("double"), "y": F.col(outcome).cast("double"), "w": F.col(weight).cast("double")})


def bin_of(p: Column, bins: int = 10) -> Column:
    """Equal bins over [0, 1]; 1 belongs to the last; values outside are clipped."""
    return F.greatest(F.lit(0), F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1)))


def kish(w: Column) -> Column:
    """Effective sample size."""
    return ratio(F.pow(F.sum(w), 2), F.sum(w * w))


def reliability(valid: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Weighted reliability per group and occupied bin."""
    p, y, w = F.col("p"), F.col("y"), F.col("w")
    return valid.withColumn("bin", bin_of(p, bins)).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sum_w"), kish(w).alias("eff_n"), ratio(F.sum(w * p), F.sum(w)).alias("mean_p"), ratio(F.sum(w * y), F.sum(w)).alias("freq"), F.avg(y).alias("freq_plain")
    )


def reliability_all_bins(valid: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """As ``reliability``, with empty bins kept (n 0, means null)."""
    r = reliability(valid, by, bins)
    grid = r.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(r, [*by, "bin"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sum_w": F.coalesce("sum_w", F.lit(0.0))})


def brier(w: Column, p: Column, y: Column) -> Column:
    return ratio(F.sum(w * F.pow(p - y, 2)), F.sum(w))


def murphy(valid: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Reliability, resolution, uncertainty and Brier score per group: bins first, then groups; no join."""
    p, y, w = F.col("p"), F.col("y"), F.col("w")
    b = valid.withColumn("bin", bin_of(p, bins)).groupBy(*by, "bin").agg(F.sum(w).alias("bw"), F.sum(w * p).alias("bp"), F.sum(w * y).alias("by_"), F.sum(w * F.pow(p - y, 2)).alias("bs"), F.count(F.lit(1)).alias("bn"))
    g = W.partitionBy(*by)
    tot, base = F.sum("bw").over(g), F.sum("by_").over(g) / F.sum("bw").over(g)
    b = b.withColumns({"share": F.col("bw") / tot, "base": base, "mp": F.col("bp") / F.col("bw"), "my": F.col("by_") / F.col("bw")})
    one = b.groupBy(*by).agg(
        F.sum("bn").alias("n"), F.max("base").alias("base_rate"), (F.sum("bs") / F.sum("bw")).alias("brier"),
        F.sum(F.col("share") * F.pow(F.col("mp") - F.col("my"), 2)).alias("reliability"), F.sum(F.col("share") * F.pow(F.col("my") - F.col("base"), 2)).alias("resolution"),
    )
    one = one.withColumn("uncertainty", F.col("base_rate") * (1 - F.col("base_rate")))
    one = one.withColumn("residual", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))
    return one.withColumn("bss", 1 - ratio(F.col("brier"), F.col("uncertainty")))


def contingency(pred: Column, actual: Column) -> list[Column]:
    """Aggregates ``hits, misses, false_alarms, correct`` over rows where both are known."""
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return [c(pred & actual).alias("hits"), c(~pred & actual).alias("misses"), c(pred & ~actual).alias("false_alarms"), c(~pred & ~actual).alias("correct")]


def table_scores() -> dict[str, Column]:
    """POD, FAR, CSI, HSS, ETS, bias and F1 from the four counts; null on empty denominators."""
    h, m, f, c = (F.col(x).cast("double") for x in ("hits", "misses", "false_alarms", "correct"))
    n = h + m + f + c
    chance = ratio((h + m) * (h + f), n)
    expected = ratio((h + m) * (h + f) + (c + m) * (c + f), n)
    return {
        "pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + m + f), "hss": ratio(h + c - expected, n - expected),
        "ets": ratio(h - chance, h + m + f - chance), "bias": ratio(h + f, h + m), "f1": ratio(2 * h, 2 * h + m + f),
    }


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def warning_scores() -> dict[str, Column]:
    """Precision, recall, F0.5/1/2 and CSI of warnings from ``hits, false_alarms, misses, late``."""
    h, f, m, l = (F.col(x).cast("double") for x in ("hits", "false_alarms", "misses", "late"))  # noqa: E741
    p, r = ratio(h, h + f), ratio(h, h + m + l)
    return {"precision": p, "recall": r, "f05": f_beta(p, r, 0.5), "f1": f_beta(p, r, 1.0), "f2": f_beta(p, r, 2.0), "csi": ratio(h, h + m + l + f)}


def by_score(valid: DataFrame, by: Sequence[str], score: str = "p", truth: str = "y") -> DataFrame:
    """Counts per distinct score with running totals from the highest score down: ``pos, neg, tp, fp, all_pos, all_neg``.

    Running totals go over a thousand stretches of scores with one carried row each, so no task holds a group's scores.
    """
    d = valid.groupBy(*by, score).agg(F.sum(F.when(F.col(truth) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) > 0, 0).otherwise(1)).alias("neg"))
    tot = d.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).withColumnsRenamed({k: f"__k_{k}" for k in by})
    d = running_sums(d, by, [F.col(score).desc()], -block_of(F.col(score), 1.0 / 1024), {"tp": F.col("pos"), "fp": F.col("neg")})
    return d.join(tot, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]).drop(*[f"__k_{k}" for k in by])


def ranking(valid: DataFrame, by: Sequence[str], score: str = "p", truth: str = "y") -> DataFrame:
    """ROC area (ties count half), average precision over distinct thresholds and the best F1, per group."""
    d = by_score(valid, by, score, truth)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("all_pos") - F.col("tp"))
    return d.groupBy(*by).agg(
        F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"),
        # positives of a score beat the negatives below it and tie with those beside it
        ratio(F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2.0)), F.max("all_pos") * F.max("all_neg")).alias("roc_auc"),
        ratio(F.sum(F.col("pos") * precision), F.max("all_pos")).alias("pr_auc"), F.max(f1).alias("best_f1"),
    )


def crps_ensemble(members: Column, obs: Column) -> Column:
    """CRPS of an ensemble: mean |x - y| less half the mean |x - x'|, by the sorted members."""
    n = F.size(members).cast("double")
    s = F.array_sort(F.transform(members, lambda x: x.cast("double")))
    near = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x - obs)) / n
    spread = F.aggregate(F.transform(s, lambda x, i: x * (2 * i.cast("double") - n + 1)), F.lit(0.0), lambda a, x: a + x) / (n * n)
    return near - spread


def rank_of(members: Column, obs: Column, draw: Column) -> Column:
    """Rank of the observation among members; ties are dealt by ``draw`` in [0, 1)."""
    below = F.size(F.filter(members, lambda x: x < obs))
    ties = F.size(F.filter(members, lambda x: x == obs))
    return (below + F.floor(draw * (ties + 1))).cast("int")


def hash_draw(*cols: Column, seed: int = 0) -> Column:
    """A fixed uniform draw in [0, 1) per row that any engine can repeat (md5)."""
    h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], width: float = 1.0) -> DataFrame:
    """``by, n, q0, q1, ...``: exact quantiles with linear interpolation between ranks, null and NaN values left out.

    Rows are counted per distinct value first; running counts go over stretches of ``width`` with one carried row each, so neither a task nor an
    aggregation buffer holds a group's values. Null groups are groups; a group without values has no row.
    """
    d = df.where(finite(F.col(value))).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    r = running_sums(d, by, [F.col("__x")], block_of(F.col("__x"), width), {"__to": F.col("__n")})
    tot = d.groupBy(*by).agg(F.sum("__n").alias("n")).withColumnsRenamed({k: f"__k_{k}" for k in by})
    j = r.join(tot, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]) if by else r.join(F.broadcast(tot))  # without groups the total is one row
    at = lambda k: F.min(F.when(F.col("__to") > k, F.col("__x")))
    pos = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    g = j.groupBy(*by, "n").agg(*[at(F.floor(x)).alias(f"__l{i}") for i, x in enumerate(pos)], *[at(F.ceil(x)).alias(f"__h{i}") for i, x in enumerate(pos)])
    return g.select(*by, "n", *[(F.col(f"__l{i}") + (x - F.floor(x)) * (F.col(f"__h{i}") - F.col(f"__l{i}"))).alias(f"q{i}") for i, x in enumerate(pos)])
