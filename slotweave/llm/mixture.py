"""Mixing sources to target weights of the total size, with capped repeats (hash-threshold histograms).

Each record has a fixed hash. A source that needs ``k`` whole copies of everything and a rest takes every record ``k`` times and, once more, the
records whose hash lies below a threshold. Thresholds come from histograms: sizes are summed by source and the top ``TOP`` bits of the hash; the
running sum shows in which bucket a budget ends; only that boundary bucket is refined, to single hashes. Budgets are nested: a smaller budget has the lower threshold, so its records are a part of the larger one's.
Records are then kept by a filter on the hash: nothing is drawn, and only a boundary bucket (one record in 2^14 of a source) is ever put in order.

Scale: the sizes (tokens) are computed once and written out (checkpoint). Two passes over (source, hash, size) follow, both with map-side sums: the histogram, whose result is
sources x 2^14 rows and which also gives each source's total, and the boundary buckets. The final filter joins the thresholds (one row per source and budget).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.runtime import cut

BITS, TOP = 60, 14


def hash_of(*cols: str):
    """A fixed non-negative 60-bit number per record."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 4)


def histogram(sizes: DataFrame) -> DataFrame:
    """``source, digit, s``: sizes by source and top bits of the hash; a null source is left out."""
    return sizes.where(F.col("source").isNotNull()).groupBy("source", F.shiftright("h", BITS - TOP).alias("digit")).agg(F.sum("size").alias("s"))


def budgets(hist: DataFrame, targets: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """``source, share, cap, fraction, have, want, copies, rest``: tokens wanted of each source and how they are made up.

    The whole is the largest total at which no source exceeds its cap; each fraction of it is one nested budget. Sources without records,
    with a null or not positive share or cap get nothing, and the shares of the others are scaled up to one.
    """
    have = hist.groupBy("source").agg(F.sum("s").alias("have")).where("have > 0")
    t = have.join(targets.select("source", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("share > 0 and cap > 0"), "source")
    # one row per source, a table the size of the target list
    every = W.partitionBy(F.lit(1))
    t = t.withColumn("share", F.col("share") / F.sum("share").over(every))
    t = t.withColumn("whole", F.min(F.col("have") * F.col("cap") / F.col("share")).over(every))
    t = t.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    t = t.withColumn("want", F.floor(F.col("whole") * F.col("share") * F.col("fraction") + F.lit(1e-6)))
    t = t.withColumn("copies", F.floor(F.col("want") / F.col("have")))
    return t.withColumn("rest", F.col("want") - F.col("copies") * F.col("have")).select("source", "share", "cap", "fraction", "have", "want", "copies", "rest")


def thresholds(sizes: DataFrame, targets: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """The budgets with ``below``: records of the source with a hash under it make up the rest, as closely as whole records allow."""
    hist = cut(histogram(sizes))
    plan = budgets(hist, targets, fractions)
    run = hist.withColumn("to", F.sum("s").over(W.partitionBy("source").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)))
    # the bucket in which the budget ends, and what the buckets before it hold
    ends = run.join(plan.select("source", "fraction", "rest"), "source").where(F.col("to") > F.col("rest"))
    edge = ends.groupBy("source", "fraction").agg(F.min(F.struct("digit", (F.col("rest") - (F.col("to") - F.col("s"))).alias("left"))).alias("e"))
    plan = cut(plan.join(edge.select("source", "fraction", "e.digit", "e.left"), ["source", "fraction"]))
    # refine it: sizes by single hash, running sums in that bucket alone
    open_ = plan.select("source", "fraction", "digit", "left")
    near = sizes.select("source", F.shiftright("h", BITS - TOP).alias("digit"), "h", "size").join(open_.select("source", "digit").distinct(), ["source", "digit"], "left_semi")
    near = near.groupBy("source", "digit", "h").agg(F.sum("size").alias("s"))
    near = near.withColumn("to", F.sum("s").over(W.partitionBy("source", "digit").orderBy("h").rowsBetween(W.unboundedPreceding, 0))).join(open_, ["source", "digit"])
    # the record at the boundary itself comes in if that ends nearer to the budget
    before = F.col("left") - (F.col("to") - F.col("s"))
    last = F.struct("h", F.when(F.col("s") - before < before, 1).otherwise(0).alias("more"))
    hit = near.where(F.col("to") > F.col("left")).groupBy("source", "fraction").agg(F.min(last).alias("m"))
    return plan.join(hit, ["source", "fraction"]).withColumn("below", F.col("m.h") + F.col("m.more")).drop("m", "digit", "left")


def mix(sizes: DataFrame, targets: DataFrame, *, fractions: Sequence[float] = (1.0,)) -> tuple[DataFrame, DataFrame]:
    """(records with ``copies`` per budget, shares reached).

    ``sizes``: ``source, h, size`` and any further columns (kept, but for ``fraction`` and ``copies``); records of size 0 or null, or of a source without target, are not
    chosen. The first result has ``fraction, source, ..., copies`` (at least 1 and at most the source's cap). The second has
    ``fraction, source, target_share, want, got, share, repeats`` for each source with a target and records.
    """
    sizes = sizes.where(F.col("size") > 0).drop("fraction", "copies")
    plan = cut(thresholds(sizes, targets, fractions))  # a row per source and budget
    t = plan.select("source", "fraction", F.col("copies").alias("__k"), F.col("below").alias("__below"), F.col("cap").alias("__cap"))
    chosen = sizes.join(t, "source").withColumn("copies", (F.col("__k") + F.when(F.col("h") < F.col("__below"), 1).otherwise(0)).cast("int"))
    chosen = chosen.where("copies > 0 and copies <= __cap")
    got = chosen.groupBy("fraction", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.max("copies").alias("repeats"))
    shares = plan.join(got, ["fraction", "source"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    total = F.sum("got").over(W.partitionBy("fraction"))
    shares = shares.select("fraction", "source", F.col("share").alias("target_share"), F.col("want"), "got", (F.col("got") / F.when(total > 0, total)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    return chosen.drop("__k", "__below", "__cap"), shares
