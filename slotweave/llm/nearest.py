"""Pairing each left row with the right row nearest in time for the same entity, within a tolerance (expanding-ring joins).

Both sides are bucketed by time. Ring 0 uses fine buckets: a left row meets the right rows of its own and the two
adjacent buckets by an equi-join on (entity, bucket). Buckets of width w show everything up to w away on
either side, so a nearest row found at a distance of w at most is provably the nearest and is accepted. Only
the left rows left over go to the next ring with doubled width, until the width reaches the tolerance.

Scale: no range join and no all-pairs group: an entity with a third of all rows is cut by its buckets. The right side is read and shuffled once, on (entity,
coarsest bucket): there it is cut down to the coarsest buckets that some left row can reach (a semi-join with their distinct numbers) and to distinct instants, and written
with ``checkpoint``. The rings read only that; finer buckets are derived from the instant by integer division. Left rows are reduced to distinct (entity, instant); later rings
carry the unresolved ones only, cut off by ``checkpoint``, so rings do not repeat earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import micros
from slotweave.runtime import cut

BLANKS = " \t\r\n\x0b\x0c\u00a0\u2007\u202f"


def entity_key(raw: Column) -> Column:
    """A station number however it is written: blanks around and leading zeros do not count; blank is null."""
    t = F.btrim(raw, F.lit(BLANKS))
    n = F.ltrim(t, F.lit("0"))
    return F.when(n != "", n).when(t != "", F.lit("0"))


def nearest(
    left: DataFrame, right: DataFrame, *, left_id: str, left_entity: Column, left_time: str, right_id: str, right_entity: Column, right_time: str, tolerance_s: int, first_ring_s: int
) -> DataFrame:
    """``left_id, right_id, entity, offset_us`` (right minus left) for every left row that has a right row within the tolerance.

    The tolerance is included. Equally near: the earlier; of right rows at one instant, the smallest id. Rows with null entity or time, or
    null id on the right, match nothing; repeated left ids each come out. Empty inputs give no rows. Other columns of the inputs are not carried, so
    clashing names do no harm.
    """
    tol, width = tolerance_s * 1_000_000, first_ring_s * 1_000_000
    top = width
    while top < tol:
        top *= 2
    l_all = left.select(F.col(left_id).alias("left_id"), left_entity.alias("entity"), micros(left_time).alias("l_us")).where("entity is not null and l_us is not null")
    r_all = right.select(F.col(right_id).alias("right_id"), right_entity.alias("entity"), micros(right_time).alias("r_us")).where("entity is not null and r_us is not null and right_id is not null")
    of = lambda us, w: F.floor(F.col(us) / F.lit(w)).cast("long")
    open_, found = l_all.select("entity", "l_us").distinct(), None
    at = lambda us: F.floor(us / F.lit(top)).cast("long")
    reach = l_all.select("entity", F.explode(F.sequence(at(F.col("l_us") - F.lit(tol)), at(F.col("l_us") + F.lit(tol)))).alias("c")).distinct()
    rows = r_all.withColumn("c", of("r_us", top)).repartition("entity", "c").join(reach, ["entity", "c"], "left_semi")
    held = cut(rows.groupBy("entity", "c", "r_us").agg(F.min("right_id").alias("right_id")))
    while True:
        b = of("l_us", width)
        probe = open_.select("entity", "l_us", F.explode(F.array(b - 1, b, b + 1)).alias("b"))
        near = held.withColumn("b", of("r_us", width))
        dist = F.abs(F.col("r_us") - F.col("l_us"))
        met = probe.join(near, ["entity", "b"], "left").groupBy("entity", "l_us").agg(F.min(F.when(dist <= F.lit(min(tol, width)), F.struct(dist.alias("d"), F.col("r_us"), F.col("right_id")))).alias("m"))
        last = width >= tol
        if not last:
            met = cut(met)
        done = met.where("m is not null").select("entity", "l_us", "m.r_us", "m.right_id")
        found = done if found is None else found.unionByName(done)
        if last:
            break
        open_ = met.where("m is null").select("entity", "l_us")
        width *= 2
    return l_all.join(found, ["entity", "l_us"]).select("left_id", "right_id", "entity", (F.col("r_us") - F.col("l_us")).alias("offset_us"))
