"""Sequential rules per station: greedy warning-onset matching with its outcomes, and the notification rule's replay.

Both depend on order, so they run as grouped maps. A station's series is first cut where nothing can carry over (a gap longer than a warning's
reach, or a coverage run), so a group is a burst of rows and not a station's history; the cuts are found over blocks (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import DAY_US, MICROS, floor_us, slot_end_us
from slotweave.operators.blocks import block_of, carried, run_numbers
from slotweave.operators.gauge import BLOCK_US, SLOT_US
from slotweave.operators.verification import quantiles, warning_scores
from slotweave.runtime import cut

MIN_US = 60 * MICROS


def bursts(rows: DataFrame, station: str, us: str, gap_min: int) -> DataFrame:
    """Adds ``burst``, a new number wherever more than ``gap_min`` passed since the station's row before, and ``block``.

    A block takes the bursts that begin in the same thirty days, so that groups are neither tiny nor a whole history.
    """
    rows = run_numbers(rows, [station], us, gap_min * MIN_US, BLOCK_US, "burst")
    return rows.withColumn("block", block_of(F.col("__start"), 30 * DAY_US)).drop("__start")


def claim(sent: np.ndarray, onsets: np.ndarray, reach: int) -> np.ndarray:
    """For each warning (in order of sending) the index of the earliest onset not yet taken in ``(sent, sent + reach]``, else -1.

    Windows are equally long, so no warning takes an onset before one taken already: the last one taken is all there is to remember.
    """
    first = np.searchsorted(onsets, sent, side="right").tolist()
    last, out = -1, np.full(len(sent), -1)
    for k, f in enumerate(first):
        i = max(last + 1, f)
        if i < len(onsets) and onsets[i] <= sent[k] + reach:
            out[k] = last = i
    return out


def match_warnings(warnings: DataFrame, onsets: DataFrame, *, lead_min: int = 30, tolerance_min: int = 10, variants: Sequence[float] = (0.0,)) -> DataFrame:
    """``variant, station_id, warning_id, t_us, onset_us``: warnings with the onset they claim (null: none), and onsets nobody claimed (``warning_id`` null).

    Each warning, in order of sending (then of id), claims the earliest unclaimed onset in ``(sent, sent + lead + tolerance]``. Rows without station or time tell nothing. Warnings with a column
    ``variant`` are matched apart for each of ``variants``; the onsets are shuffled once for all.
    """
    reach = (lead_min + tolerance_min) * MIN_US
    variant = F.col("variant").cast("double") if "variant" in warnings.columns else F.lit(float(variants[0]))
    none = F.lit(None).cast("long").alias("warning_id")
    both = warnings.select("station_id", variant.alias("variant"), "warning_id", F.col("t_us").alias("us"))
    both = both.unionByName(onsets.select("station_id", F.lit(None).cast("double").alias("variant"), none, F.col("onset_us").alias("us")))
    both = bursts(both.where("station_id is not null and us is not null"), "station_id", "us", lead_min + tolerance_min)

    # warnings of one burst cannot reach the onsets of another, so a block is taken in one go
    def work(key: tuple, t: pa.Table) -> pa.Table:
        us, var = t.column("us").to_numpy(), t.column("variant").to_numpy(zero_copy_only=False).astype(float)
        wid = t.column("warning_id").fill_null(-1).to_numpy()
        on = np.sort(us[np.isnan(var)])
        parts = []
        for v in variants:
            w = np.flatnonzero(var == v)
            w = w[np.lexsort((wid[w], us[w]))]
            at = claim(us[w], on, reach)
            free = np.setdiff1d(np.arange(len(on)), at[at >= 0])
            lone, n = np.zeros(len(free), np.int64), len(w) + len(free)
            unsent = np.r_[np.zeros(len(w), bool), np.ones(len(free), bool)]
            got = np.r_[on[at] if len(on) else np.zeros(len(w), np.int64), on[free]].astype(np.int64)
            parts.append(pa.table({
                "variant": pa.array(np.full(n, float(v))), "station_id": pa.array([key[0].as_py()] * n, pa.string()), "warning_id": pa.array(np.r_[wid[w], lone], mask=unsent),
                "t_us": pa.array(np.r_[us[w], lone], mask=unsent), "onset_us": pa.array(got, mask=np.r_[at < 0, np.zeros(len(free), bool)]),
            }))
        return pa.concat_tables(parts)

    return both.groupBy("station_id", "block").applyInArrow(work, "variant double, station_id string, warning_id long, t_us long, onset_us long")


def covered(onsets: DataFrame, runs: DataFrame) -> DataFrame:
    """``station_id, onset_us, covered``: whether an onset lies in a coverage run (both ends included): the last run begun by then is carried over blocks."""
    u = onsets.select("station_id", F.col("onset_us").alias("us"), F.lit(None).cast("long").alias("to_us"), F.lit(1).alias("o"))
    u = u.unionByName(runs.select("station_id", F.col("from_us").alias("us"), "to_us", F.lit(0).alias("o"))).withColumn("block", block_of(F.col("us"), BLOCK_US))
    u = carried(u, ["station_id"], "block", {"m": F.max("to_us")}, {"before": ("max", F.col("m"))})
    w = W.partitionBy("station_id", "block").orderBy("us", "o").rowsBetween(W.unboundedPreceding, 0)
    end = F.greatest(F.max("to_us").over(w), F.col("before"))
    return u.withColumn("end", end).where("o = 1").select("station_id", F.col("us").alias("onset_us"), F.coalesce(F.col("us") <= F.col("end"), F.lit(False)).alias("covered"))


def score_warnings(
    warnings: DataFrame, onsets: DataFrame, *, slots: DataFrame | None = None, runs: DataFrame | None = None, lead_min: int = 30, tolerance_min: int = 10, dry_min: int = 60, useful_min: int = 5,
    variants: Sequence[float] = (0.0,),
) -> DataFrame:
    """Every warning and every onset with its outcome: ``variant, station_id, side, warning_id, event_us, onset_us, outcome, lead_error_min, all_clear, clear_min``.

    ``warnings``: ``station_id, warning_id, t_us, eta_min, all_clear_us``. Side ``warning``: ``hit``, ``late`` (claimed less than ``useful_min`` ahead), ``pending`` (its window ends after the station's
    last known slot), ``unscorable`` (a slot in ``(sent - dry, sent + lead + tolerance]`` is unknown) or ``false_alarm``. Side ``onset``: ``hit``, ``miss_late``, ``uncovered`` (outside all ``runs``), ``pending``
    (within the tolerance of the last known slot) or ``miss``. Without ``slots`` nothing is pending or unscorable, without ``runs`` nothing uncovered. ``lead_error_min`` is ETA less
    delivered lead. An all-clear is ``right`` on a false alarm, ``wrong`` before the onset, else ``after_onset``; ``pending`` and ``unscorable`` pass on.
    """
    window, grace = (lead_min + tolerance_min) * MIN_US, tolerance_min * MIN_US
    m = cut(match_warnings(warnings, onsets, lead_min=lead_min, tolerance_min=tolerance_min, variants=variants))
    key = ["variant", "station_id", "warning_id"]
    variant = F.col("variant").cast("double") if "variant" in warnings.columns else F.lit(float(variants[0]))
    w = m.where("warning_id is not null").join(warnings.select(variant.alias("variant"), "station_id", "warning_id", F.col("eta_min").cast("double").alias("eta"), "all_clear_us"), key)
    w = w.withColumns({"until": F.lit(None).cast("long"), "full": F.lit(True)})
    o = m.select("variant", "station_id", "onset_us", F.col("t_us").alias("claimed_us"), F.col("warning_id").alias("claimer")).where("onset_us is not null")
    o = o.withColumns({"until": F.lit(None).cast("long"), "covered": F.lit(True)})
    if slots is not None:
        until = slots.where("wet is not null").groupBy("station_id").agg(F.max("slot_us").alias("until"))  # one row a station
        w, o = w.drop("until").join(until, "station_id", "left"), o.drop("until").join(until, "station_id", "left")
        end, first = F.col("t_us") + F.lit(window), slot_end_us(F.col("t_us") - F.lit(dry_min * MIN_US) + F.lit(1))
        probe = w.where("onset_us is null").select("station_id", "warning_id", "t_us").distinct().select("station_id", "warning_id", F.explode(F.sequence(first, floor_us(end, SLOT_US), F.lit(SLOT_US))).alias("slot_us"))
        known = probe.join(slots.select("station_id", "slot_us", "wet"), ["station_id", "slot_us"], "left").groupBy("station_id", "warning_id").agg(F.every(F.col("wet").isNotNull()).alias("full"))
        w = w.drop("full").join(known, ["station_id", "warning_id"], "left")
    if runs is not None:
        o = o.drop("covered").join(covered(o.select("station_id", "onset_us").distinct(), runs), ["station_id", "onset_us"])
    claimed, real = F.col("onset_us").isNotNull(), (F.col("onset_us") - F.col("t_us")) / F.lit(float(MIN_US))
    outcome = (
        F.when(claimed & (real >= useful_min), "hit").when(claimed, "late").when(F.col("t_us") + F.lit(window) > F.col("until"), "pending").when(~F.coalesce("full", F.lit(True)), "unscorable").otherwise("false_alarm")
    )
    w = w.withColumn("outcome", outcome)
    clear = F.when(F.col("outcome").isin("pending", "unscorable"), F.col("outcome")).when(F.col("outcome") == "false_alarm", "right").when(F.col("all_clear_us") < F.col("onset_us"), "wrong").otherwise("after_onset")
    w = w.select(
        "variant", "station_id", F.lit("warning").alias("side"), "warning_id", F.col("t_us").alias("event_us"), "onset_us", "outcome", F.when(claimed, F.col("eta") - real).alias("lead_error_min"),
        F.when(F.col("all_clear_us").isNotNull(), clear).alias("all_clear"), ((F.col("all_clear_us") - F.col("t_us")) / F.lit(float(MIN_US))).alias("clear_min"),
    )
    lead = (F.col("onset_us") - F.col("claimed_us")) / F.lit(float(MIN_US))
    verdict = F.when(lead >= useful_min, "hit").when(lead.isNotNull(), "miss_late").when(~F.col("covered"), "uncovered").when(F.col("onset_us") + F.lit(grace) > F.col("until"), "pending").otherwise("miss")
    o = o.select(
        "variant", "station_id", F.lit("onset").alias("side"), F.col("claimer").alias("warning_id"), F.col("onset_us").alias("event_us"), "onset_us", verdict.alias("outcome"), F.lit(None).cast("double").alias("lead_error_min"),
        F.lit(None).cast("string").alias("all_clear"), F.lit(None).cast("double").alias("clear_min"),
    )
    return w.unionByName(o)


COUNTS = ("n_sent", "warnings", "hits", "late", "false_alarms", "pending", "unscorable", "n_onsets", "misses", "pending_onsets", "uncovered_onsets", "all_clears", "all_clears_right", "all_clears_wrong", "all_clears_after_onset", "all_clears_pending")


def pooled_summary(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, rates and quantiles per group, from pooled counts: scored warnings, pending and unscorable apart, lead errors over hits, minutes to the all-clear.

    ``hits + late + false_alarms = warnings`` and ``hits + late + misses = n_onsets - pending_onsets - uncovered_onsets`` hold always.
    """
    side, out, clear = F.col("side") == "warning", F.col("outcome"), F.col("all_clear")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    graded = ["right", "wrong", "after_onset"]
    g = events.groupBy(*by).agg(
        n(side).alias("n_sent"), n(side & ~out.isin("pending", "unscorable")).alias("warnings"), n(side & (out == "hit")).alias("hits"), n(side & (out == "late")).alias("late"), n(out == "false_alarm").alias("false_alarms"),
        n(side & (out == "pending")).alias("pending"), n(out == "unscorable").alias("unscorable"), n(~side).alias("n_onsets"), n(out == "miss").alias("misses"), n(~side & (out == "pending")).alias("pending_onsets"),
        n(out == "uncovered").alias("uncovered_onsets"), n(clear.isin(*graded)).alias("all_clears"), *[n(clear == x).alias(f"all_clears_{x}") for x in graded], n(clear.isin("pending", "unscorable")).alias("all_clears_pending"),
    )
    g = g.withColumns(warning_scores() | {"far": F.try_divide(F.col("false_alarms").cast("double"), F.col("warnings"))})
    hit = side & (out == "hit") & F.col("lead_error_min").isNotNull()
    err = quantiles(events.where(hit), by, "lead_error_min", (0.25, 0.5, 0.75), 4.0).withColumnsRenamed({"n": "n_errors", "q0": "error_p25", "q1": "error_p50", "q2": "error_p75"})
    med = quantiles(events.where(clear.isin(*graded) & F.col("clear_min").isNotNull()), by, "clear_min", (0.5,), 16.0).drop("n").withColumnRenamed("q0", "all_clear_p50")
    for extra in (err, med):
        extra = extra.withColumnsRenamed({k: f"__{k}" for k in by})
        g = g.join(extra, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by], "left").drop(*[f"__{k}" for k in by])
    return g.withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))


@dataclass(frozen=True)
class Rule:
    """Constants of the notification rule; thresholds in percent. With ``onset_threshold`` both probabilities must reach theirs; without a reading of the second, ``single_threshold`` holds for the first."""

    persistence: int = 1
    rearm_min: int = 60
    clear_after: int = 2
    onset_threshold: float | None = None
    single_threshold: float | None = None


def over(p: float, threshold: float, rule: Rule, p_onset: float | None = None) -> bool:
    if rule.onset_threshold is None:
        return p >= threshold / 100
    if p_onset is None or p_onset != p_onset:
        return p >= (threshold if rule.single_threshold is None else rule.single_threshold) / 100
    return p_onset >= rule.onset_threshold / 100 and p >= threshold / 100


def fresh() -> dict:
    return {"armed": True, "streak": 0, "below": None, "seen": None, "notified": False, "calm": 0, "cleared": False}


STATE = ("armed", "streak", "below", "seen", "notified", "calm", "cleared")


def step(state: dict, us: int, p: float | None, raining: bool, threshold: float, rule: Rule, p_onset: float | None = None, quiet: bool = False) -> str:
    """One reading through the notification rule; ``state`` is changed in place; the action is returned.

    Readings not newer than the last one seen do nothing; without a probability only the clock moves. Disarmed, the rule re-arms after a spell
    below the threshold and, once per push, calls the all-clear; armed, it counts readings over the threshold. In quiet hours it waits armed.
    """
    if state["seen"] is not None and us <= state["seen"]:
        return "none"
    state["seen"] = us
    if p is None or p != p:
        return "none"
    hot = over(p, threshold, rule, p_onset)
    streak = state["streak"] + 1 if hot else 0
    if not state["armed"]:
        if state["below"] is None or us - state["below"] < rule.rearm_min * MIN_US:
            clear = False
            if state["notified"] and not state["cleared"] and rule.clear_after > 0:
                state["calm"] = 0 if hot else state["calm"] + 1
                clear = state["calm"] >= rule.clear_after
            below = None if hot else us if state["below"] is None else state["below"]
            state.update(streak=streak, below=below, cleared=state["cleared"] or clear)
            return "all_clear" if clear else "none"
        state.update(fresh() | {"seen": us})
        streak = 1 if hot else 0
    state["streak"] = streak
    if streak < rule.persistence:
        return "none"
    if quiet:
        return "deferred_quiet"
    state.update(armed=False, below=None, calm=0, cleared=False, notified=not raining)
    return "already_raining" if raining else "notify"


def replay(decisions: DataFrame, *, thresholds: Sequence[float], rule: Rule = Rule(), gap_min: int = 120, traced: bool = False) -> DataFrame:
    """Actions of the rule over each station's coverage runs for every threshold (percent).

    ``decisions``: ``station_id, us, row_id, p, raining`` and, if there, ``p_onset`` and ``quiet``. Result: ``thr, station_id, row_id, us, run, action`` for rows with an action; ``traced`` gives
    every row with the state after it (``armed, streak, below_us, notified, calm``). State starts anew with each run, so groups end where runs end; the rows are shuffled once for all thresholds.
    """
    extra = [c for c in ("p_onset", "quiet") if c in decisions.columns]
    rows = bursts(decisions.select("station_id", "us", "row_id", "p", "raining", *extra).where("station_id is not null and us is not null"), "station_id", "us", gap_min)
    schema = "thr double, station_id string, row_id long, us long, run long, action string" + (", armed boolean, streak int, below_us long, notified boolean, calm int" if traced else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(key: tuple, t: pa.Table) -> pa.Table:
        us, rid, run = t.column("us").to_pylist(), t.column("row_id").to_pylist(), t.column("burst").to_pylist()
        p, wet = t.column("p").to_pylist(), t.column("raining").to_pylist()
        second = t.column("p_onset").to_pylist() if "p_onset" in extra else [None] * len(us)
        quiet = t.column("quiet").to_pylist() if "quiet" in extra else [False] * len(us)
        order, out = sorted(range(len(us)), key=lambda i: (run[i], us[i], rid[i])), []
        for thr in thresholds:
            state, last = fresh(), None
            for i in order:
                if run[i] != last:
                    state, last = fresh(), run[i]
                a = step(state, us[i], p[i], bool(wet[i]), thr, rule, second[i], bool(quiet[i]))
                if traced:
                    out.append((float(thr), key[0].as_py(), rid[i], us[i], run[i], a, *(state[k] for k in ("armed", "streak", "below", "notified", "calm"))))
                elif a != "none":
                    out.append((float(thr), key[0].as_py(), rid[i], us[i], run[i], a))
        cols = list(zip(*out)) if out else [()] * len(names)
        kinds = {"double": pa.float64(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
        return pa.table({n: pa.array(c, kinds[s.split()[1]]) for n, c, s in zip(names, cols, schema.split(", "))})

    return rows.groupBy("station_id", "block").applyInArrow(work, schema)


def pushes(actions: DataFrame) -> DataFrame:
    """``thr, station_id, warning_id, t_us, all_clear_us``: the notifications of a replay, each with the all-clear that came before the next one of its run."""
    a = actions.where("action in ('notify', 'all_clear')")
    w = W.partitionBy("thr", "station_id", "run").orderBy("us")
    nxt = a.withColumns({"next": F.lead("action").over(w), "next_us": F.lead("us").over(w)})
    return nxt.where("action = 'notify'").select("thr", "station_id", F.col("row_id").alias("warning_id"), F.col("us").alias("t_us"), F.when(F.col("next") == "all_clear", F.col("next_us")).alias("all_clear_us"))
