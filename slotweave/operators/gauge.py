"""Gauge truth: slots with three-valued wetness, onsets, coverage runs, window outcomes and as-of lookups.

Unknown is not dry: ``wet`` is true, false or null, and no step turns null into false. Windows of minutes are answered by
equi-joins on the few slots they hold, never by range joins; steps that need order run over blocks of a station (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import DAY_US, MICROS, floor_us, micros, slot_end_us
from slotweave.operators.blocks import block_of, run_numbers, with_margin

SLOT_US = 600 * MICROS
#: Fixed values of the scoring rules.
WET_MM, WET_DUR_MIN, DRY_MIN, ONSET_MM = 0.1, 1.0, 60, 0.2


def amount(v: Column) -> Column:
    """Negative (trace) is 0; NaN is null."""
    d = v.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), F.greatest(d, F.lit(0.0)))


def wet_of(mm: Column, dur: Column) -> Column:
    """Wet by depth or by duration; dry if what is known says so; null if neither is known."""
    known = mm.isNotNull() | dur.isNotNull()
    return F.when(known, F.coalesce(mm >= WET_MM, F.lit(False)) | F.coalesce(dur >= WET_DUR_MIN, F.lit(False)))


def slot_amounts(obs: DataFrame, station: str = "station_id", after_min: int = 0) -> DataFrame:
    """``station, slot_us, mm, dur, wet`` of every slot from a station's first to its last reported one (and ``after_min`` beyond).

    Per slot and parameter the greatest usable reading counts; null readings do not make a slot known. Readings are shuffled once,
    on (station, day), and folded into one row a day; days without a reading come from the station's span, one row each, so no task holds a whole station.
    """
    v = amount(F.col("value"))
    kind = lambda p: F.max(F.when(F.col("parameter_id") == p, v))
    rows = obs.where(F.col("parameter_id").isin("precip_past10min", "precip_dur_past10min") & F.col(station).isNotNull() & F.col("observed_utc").isNotNull())
    rows = rows.select(station, "parameter_id", "value", slot_end_us(micros("observed_utc")).alias("slot_us")).withColumn("day", block_of(F.col("slot_us"), DAY_US))
    folded = rows.repartition(F.col(station), F.col("day")).groupBy(station, "day", "slot_us").agg(kind("precip_past10min").alias("mm"), kind("precip_dur_past10min").alias("dur"))
    folded = folded.where("mm is not null or dur is not null")
    days = folded.groupBy(station, "day").agg(F.map_from_entries(F.collect_list(F.struct("slot_us", F.struct("mm", "dur")))).alias("m"), F.min("slot_us").alias("a"), F.max("slot_us").alias("b"))
    span = days.groupBy(station).agg(F.min("a").alias("a"), (F.max("b") + F.lit(after_min * 60 * MICROS)).alias("b"))
    grid = span.select(station, "a", "b", F.explode(F.sequence(block_of(F.col("a"), DAY_US), block_of(F.col("b"), DAY_US))).alias("day"))
    slot = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(143)), lambda k: F.col("day") * F.lit(DAY_US) + k.cast("long") * F.lit(SLOT_US)), lambda u: (u >= F.col("a")) & (u <= F.col("b"))))
    out = grid.join(days.select(station, "day", "m"), [station, "day"], "left").select(station, "m", slot.alias("slot_us"))
    out = out.select(station, "slot_us", F.col("m")[F.col("slot_us")].alias("x")).select(station, "slot_us", "x.mm", "x.dur")
    return out.withColumn("wet", wet_of(F.col("mm"), F.col("dur")))


#: Series are cut into blocks of so many days; see ``blocks``.
BLOCK_US = 8 * DAY_US


def onsets(slots: DataFrame, station: str = "station_id", dry_min: int = DRY_MIN, least_mm: float = ONSET_MM) -> DataFrame:
    """Onsets of rain: a wet slot after ``dry_min`` of known dry slots whose depth with the next slot reaches ``least_mm``.

    Blocks of a station with the slots before and after as margin; no station sits in one task.
    """
    need = max(1, -(-dry_min // 10))
    w = W.partitionBy(station, "block").orderBy("slot_us")
    dry = F.sum(F.when(~F.col("wet"), 1).otherwise(0)).over(w.rowsBetween(-need, -1))
    depth = F.coalesce("mm", F.lit(0.0)) + F.coalesce(F.lead("mm").over(w), F.lit(0.0))
    rows = with_margin(slots, "slot_us", BLOCK_US, need * SLOT_US, SLOT_US).withColumns({"dry_before": dry, "depth": depth})
    return rows.where(F.col("core") & (F.col("dry_before") == need) & F.col("wet") & (F.col("depth") >= least_mm - 1e-9)).select(station, F.col("slot_us").alias("onset_us"), "depth")


def coverage_runs(df: DataFrame, key: str, us: Column, gap_min: int = 20, extend_min: int = 0) -> DataFrame:
    """Runs of rows no more than ``gap_min`` apart: ``key, run, from_us, to_us, n``; the end is pushed out by ``extend_min``."""
    rows = df.select(key, us.alias("us")).where(F.col(key).isNotNull() & F.col("us").isNotNull())
    runs = run_numbers(rows, [key], "us", gap_min * 60 * MICROS, BLOCK_US)
    return runs.groupBy(key, "run").agg(F.min("us").alias("from_us"), (F.max("us") + F.lit(extend_min * 60 * MICROS)).alias("to_us"), F.count(F.lit(1)).alias("n"))


def trailing_features(slots: DataFrame, station: str = "station_id", windows: Sequence[int] = (10, 30, 60), cap_min: int = 360) -> DataFrame:
    """Per slot, of the slots up to it: ``g_mm_<w>`` (null if no depth is known), ``g_known_30``, ``g_wet_30``, ``g_dry_60``, ``last_wet_us`` and ``last_known_us`` within ``cap_min``.

    ``g_dry_60`` is 0 after a wet slot in the hour, 1 if any of the hour is known and none wet, else null. Blocks with ``cap_min`` as margin.
    """
    w = W.partitionBy(station, "block").orderBy("slot_us")
    r = lambda m: w.rangeBetween(-(m - 10) * 60 * MICROS, 0)
    wet = F.col("wet")
    rows = with_margin(slots, "slot_us", BLOCK_US, cap_min * 60 * MICROS)
    cap = w.rangeBetween(-cap_min * 60 * MICROS, 0)
    out = rows.withColumns({f"g_mm_{m}": F.sum("mm").over(r(m)) for m in windows})
    out = out.withColumns({
        "g_known_30": F.count(wet).over(r(30)), "g_wet_30": F.coalesce(F.max(wet).over(r(30)), F.lit(False)), "g_dry_60": F.when(F.max(wet).over(r(60)), 0).when(F.count(wet).over(r(60)) > 0, 1),
        "last_wet_us": F.max(F.when(wet, F.col("slot_us"))).over(cap), "last_known_us": F.max(F.when(wet.isNotNull(), F.col("slot_us"))).over(cap),
    })
    return out.where("core").drop("block", "core", "mm", "dur", "wet")


def features_at(decisions: DataFrame, slots: DataFrame, *, station: str, at_us: str, row_id: Sequence[str], lag_min: int = 10, cap_min: int = 360) -> DataFrame:
    """What a station's gauge shows at each decision: only slots that ended ``lag_min`` before are visible.

    Depths and dryness count back from that horizon, ``g_min_since_wet`` from the decision (at most ``cap_min``; null if nothing was known that long). ``g_known``
    is 1 if the last visible hour has a known slot. ``slots`` must reach ``cap_min`` beyond the last known slot. One equi-join.
    """
    cap = F.lit(cap_min * 60 * MICROS)
    left = decisions.select(*row_id, station, F.col(at_us).alias("__at"), floor_us(F.col(at_us) - F.lit(lag_min * 60 * MICROS), SLOT_US).alias("slot_us"))
    j = left.join(trailing_features(slots, station, cap_min=cap_min), [station, "slot_us"], "left")
    seen = F.col("last_known_us") >= F.col("__at") - cap
    since = F.when(seen, F.coalesce(F.least(F.floor((F.col("__at") - F.col("last_wet_us")) / F.lit(60 * MICROS)), F.lit(cap_min)), F.lit(cap_min)))
    only = lambda c: F.when(seen, F.col(c)).alias(c)
    return j.select(*row_id, *[only(f"g_mm_{m}") for m in (10, 30, 60)], since.cast("long").alias("g_min_since_wet"), only("g_dry_60"), F.coalesce((seen & F.col("g_dry_60").isNotNull()).cast("int"), F.lit(0)).alias("g_known"))


def window_outcome(left: DataFrame, slots: DataFrame, *, station: str, at_us: str, minutes: int, row_id: Sequence[str]) -> DataFrame:
    """For each left row whether any slot ending in ``(at, at + minutes]`` is wet; null unless wet or all known.

    Each left row meets its few slots by an equi-join; no range join.
    """
    first = slot_end_us(F.col(at_us) + F.lit(1))
    n = minutes // 10
    probe = left.select(*row_id, station, at_us, F.explode(F.sequence(first, F.col(at_us) + F.lit(minutes * 60 * MICROS), F.lit(SLOT_US).cast("long"))).alias("slot_us"))
    met = probe.join(slots.select(station, "slot_us", "wet", "mm"), [station, "slot_us"], "left")
    out = met.groupBy(*row_id).agg(F.max("wet").alias("any_wet"), F.count("wet").alias("n_known"), F.count(F.lit(1)).alias("n_slots"), F.sum("mm").alias("mm"))
    return out.withColumn("outcome", F.when(F.col("any_wet"), 1).when(F.col("n_known") == F.col("n_slots"), 0)).withColumn("expected", F.lit(n))


def as_of(left: DataFrame, right: DataFrame, *, key: str, left_us: str, right_us: str, value: str, row_id: Sequence[str], within_min: int, forward: bool = False, strict: bool = False) -> DataFrame:
    """The nearest earlier (or later) right row of the key within ``within_min``: ``row_id, found_us, found``.

    Both sides are bucketed at the tolerance; a left row meets its own bucket and the one before (after).
    """
    width = F.lit(within_min * 60 * MICROS)
    b = F.floor(F.col(left_us) / width)
    probe = left.select(*row_id, key, left_us, F.explode(F.array(b, b + (1 if forward else -1))).alias("b"))
    held = right.select(key, F.col(right_us).alias("__r"), F.col(value).alias("__v"), F.floor(F.col(right_us) / width).alias("b"))
    d = (F.col("__r") - F.col(left_us)) if forward else (F.col(left_us) - F.col("__r"))
    ok = (d > 0 if strict else d >= 0) & (d <= width)
    best = F.min(F.when(ok, F.struct(d.alias("d"), F.col("__r").alias("r"), F.col("__v").alias("v"))))
    return probe.join(held, [key, "b"], "left").groupBy(*row_id).agg(best.alias("m")).select(*row_id, F.col("m.r").alias("found_us"), F.col("m.v").alias("found"))
