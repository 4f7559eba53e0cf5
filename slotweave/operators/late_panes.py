"""Per-period aggregates by event time, corrected as late records arrive (stream slicing).

The event-time axis is cut into non-overlapping panes at window-boundary granularity. Every
delivery turns into a *change* of exactly one pane: a first delivery adds one reading and its amount; a repeated delivery of the same key replaces the amount it gave
before. The changes of a pane are kept as *partials*, one row per pane and arrival tick, whatever the number of deliveries. A window is composed of the partials of the panes it covers, so a
late change touches one pane, and only the windows over that pane are composed and emitted again.

Scale: one shuffle of deliveries, on (source, pane). A source with a third of all rows spreads over its panes.
Panes are small by construction; the order of deliveries inside a key is a window function over a
handful of rows. Windows of several panes copy partials, not rows. Everything stays in whole-stage code; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import floor_us, micros

MINUTE_US = 60_000_000


def pane_partials(
    df: DataFrame,
    *,
    keys: Sequence[str],
    event: str,
    arrival: Column,
    amount: Column,
    order: str,
    pane_min: int = 60,
    panes: int = 1,
    cutoff_min: int | None = 24 * 60,
    tick_min: int = 1,
) -> DataFrame:
    """Partials of panes: ``keys, pane_us, tick_us, d_count, d_amount``: what the deliveries that arrived up to the tick, and after the one before, change.

    ``amount`` is a whole number (a fixed-point value), so that corrections cancel exactly. Rows with
    null key, event time or amount tell nothing. A null ``arrival`` counts as the event time. Of one
    key and event time the delivery arrived last counts, then the greater ``order``. Deliveries after the cut-off of the last window of ``panes`` panes over the pane
    (its end + ``cutoff_min``) are dropped (``None``: never). Waits and panes must be multiples of the tick; then results at them are exact. Changes that cancel within a
    tick leave no partial. Empty input gives no rows; further columns of ``df`` are ignored.
    """
    pane, tick = pane_min * MINUTE_US, tick_min * MINUTE_US
    ev = micros(event)
    rows = df.select(
        *[F.col(k) for k in keys],
        ev.alias("__event_us"),
        floor_us(ev, pane).alias("pane_us"),
        F.coalesce(micros(arrival), ev).alias("__arrival_us"),
        amount.cast("long").alias("__amount"),
        F.col(order).alias("__order"),
    ).where(F.col("__event_us").isNotNull() & F.col("__amount").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if cutoff_min is not None:
        rows = rows.where(F.col("__arrival_us") <= F.col("pane_us") + F.lit(panes * pane + cutoff_min * MINUTE_US))
    # one exchange serves the window below and every later grouping by (keys, pane)
    rows = rows.repartition(*[F.col(k) for k in keys], F.col("pane_us"))
    before = F.lag("__amount").over(W.partitionBy(*keys, "pane_us", "__event_us").orderBy("__arrival_us", "__order"))
    changes = rows.withColumn("__before", before).select(
        *keys,
        "pane_us",
        (F.col("__arrival_us") + F.pmod(-F.col("__arrival_us"), F.lit(tick))).alias("tick_us"),
        F.when(F.col("__before").isNull(), 1).otherwise(0).cast("long").alias("d_count"),
        (F.col("__amount") - F.coalesce(F.col("__before"), F.lit(0))).alias("d_amount"),
    )
    folded = changes.groupBy(*keys, "pane_us", "tick_us").agg(F.sum("d_count").alias("d_count"), F.sum("d_amount").alias("d_amount"))
    return folded.where("d_count <> 0 or d_amount <> 0")


def windows_of(partials: DataFrame, *, pane_min: int = 60, panes: int = 1) -> DataFrame:
    """Route every partial to the ``panes`` windows that cover its pane: adds ``window_us`` (the start).

    Windows of ``panes`` panes slide by one pane; ``panes=1`` gives tumbling windows and no copy.
    """
    if panes == 1:
        return partials.withColumn("window_us", F.col("pane_us"))
    step = pane_min * MINUTE_US
    starts = F.array(*[F.col("pane_us") - F.lit(i * step) for i in range(panes)])
    return partials.withColumn("window_us", F.explode(starts))


def results_at(partials: DataFrame, *, keys: Sequence[str], waits_min: Sequence[int], pane_min: int = 60, panes: int = 1) -> DataFrame:
    """The result of each window as it stood ``waits_min`` minutes after its end (arrivals up to then included).

    Columns: ``keys, window_us`` and for each wait ``count_<w>, amount_<w>``. A window without a
    reading by then has 0 and 0; windows without any change have no row.
    """
    end = F.col("window_us") + F.lit(pane_min * panes * MINUTE_US)
    aggs = []
    for w in waits_min:
        seen = F.col("tick_us") <= end + F.lit(w * MINUTE_US)
        aggs.append(F.sum(F.when(seen, F.col("d_count")).otherwise(0)).alias(f"count_{w}"))
        aggs.append(F.sum(F.when(seen, F.col("d_amount")).otherwise(0)).alias(f"amount_{w}"))
    return windows_of(partials, pane_min=pane_min, panes=panes).groupBy(*keys, "window_us").agg(*aggs)


def emissions(partials: DataFrame, *, keys: Sequence[str], first_wait_min: int, cutoff_min: int, pane_min: int = 60, panes: int = 1) -> DataFrame:
    """Every result a window publishes: the first at end + ``first_wait_min``, then one per tick that changes it until the cut-off.

    Columns: ``keys, window_us, emitted_us, n, amount, revision``. Revision 0 is the result at the first wait (a window without a
    reading by then publishes none), later ones count on. Ticks that leave both numbers of the window as they were publish nothing.
    """
    end = F.col("window_us") + F.lit(pane_min * panes * MINUTE_US)
    first, last = end + F.lit(first_wait_min * MINUTE_US), end + F.lit(cutoff_min * MINUTE_US)
    routed = (
        windows_of(partials, pane_min=pane_min, panes=panes)
        .where(F.col("tick_us") <= last)
        .withColumn("emitted_us", F.greatest(F.col("tick_us"), first))
        .groupBy(*keys, "window_us", "emitted_us")
        .agg(F.sum("d_count").alias("d_count"), F.sum("d_amount").alias("d_amount"))
        .where("d_count <> 0 or d_amount <> 0")
    )
    order = W.partitionBy(*keys, "window_us").orderBy("emitted_us")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    late = F.sum(F.when(F.col("emitted_us") > first, 1).otherwise(0)).over(run)
    return routed.select(*keys, "window_us", "emitted_us", F.sum("d_count").over(run).alias("n"), F.sum("d_amount").over(run).alias("amount"), late.alias("revision"))


def corrected(emitted: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``keys, window_us, n_first, amount_first, n_last, amount_last`` of windows whose last publication differs from revision 0 (0 and 0 if there was none)."""
    pub = F.struct("n", "amount")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("amount"))
    g = emitted.groupBy(*keys, "window_us").agg(F.max_by(pub, "emitted_us").alias("l"), F.coalesce(F.max(F.when(F.col("revision") == 0, pub)), zero).alias("f"))
    return g.where("l <> f").select(*keys, "window_us", F.col("f.n").alias("n_first"), F.col("f.amount").alias("amount_first"), F.col("l.n").alias("n_last"), F.col("l.amount").alias("amount_last"))
