"""Queries of warning scores, threshold picks, calibration, resampling and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import MICROS
from slotweave.operators import blocks as B
from slotweave.operators import calibration, matching
from slotweave.operators import gauge as G
from slotweave.operators import verification as V
from slotweave.plans.gauges import _ONSETS, _SLOTS, _WARN, slots, warnings
from slotweave.plans.reports import _V, r6, valid
from slotweave.runtime import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Fixed values of the scoring: lead, tolerance, useful lead and dry spell in minutes; gap of a coverage run.
LEAD, TOLERANCE, USEFUL, DRY, GAP = 30, 10, 5, 60, 120
THRESHOLDS = list(range(30, 95, 5))


def coverage(spark: SparkSession, base: str) -> DataFrame:
    return G.coverage_runs(warnings(spark, base), "station_id", F.col("t_us"), gap_min=GAP, extend_min=LEAD + TOLERANCE)


def scored(spark: SparkSession, base: str, sent: DataFrame, **k) -> DataFrame:
    s = cut(slots(spark, base))  # read four times below
    return matching.score_warnings(sent, G.onsets(s), slots=s, runs=coverage(spark, base), lead_min=LEAD, tolerance_min=TOLERANCE, dry_min=DRY, useful_min=USEFUL, **k)


def events(spark: SparkSession, base: str) -> DataFrame:
    sent = warnings(spark, base).select("station_id", "warning_id", "t_us", F.when(~F.isnan("eta_min"), F.col("eta_min")).alias("eta_min"), F.lit(None).cast("long").alias("all_clear_us"))
    return scored(spark, base, sent)


def score_sql(sent: str) -> str:
    """CTEs from ``sn`` (variant, station_id, warning_id, t_us, eta_min, all_clear_us) to ``ev``: one claim after another by recursion."""
    return f"""{_WARN}, {_SLOTS}, {_ONSETS}, {sent},
wk AS (SELECT *, row_number() OVER (PARTITION BY variant, station_id ORDER BY t_us, warning_id) AS k FROM sn),
ok AS (SELECT station_id, onset_us, row_number() OVER (PARTITION BY station_id ORDER BY onset_us) AS i FROM n),
fi AS (SELECT variant, wk.station_id, k, t_us, count(ok.i) + 1 AS first FROM wk LEFT JOIN ok ON ok.station_id = wk.station_id AND ok.onset_us <= wk.t_us GROUP BY 1, 2, 3, 4),
rec AS (SELECT DISTINCT variant, station_id, 0::BIGINT AS k, 0::BIGINT AS c, NULL::BIGINT AS pick FROM wk UNION ALL
  SELECT f.variant, f.station_id, f.k, coalesce(o.i, r.c), o.i FROM rec r JOIN fi f ON f.variant = r.variant AND f.station_id = r.station_id AND f.k = r.k + 1
  LEFT JOIN ok o ON o.station_id = f.station_id AND o.i = greatest(r.c + 1, f.first) AND o.onset_us <= f.t_us + 2400000000),
cl AS (SELECT wk.*, ok.onset_us FROM wk JOIN rec USING (variant, station_id, k) LEFT JOIN ok ON ok.station_id = wk.station_id AND ok.i = rec.pick),
ku AS (SELECT station_id, max(slot_us) AS until FROM s WHERE wet IS NOT NULL GROUP BY 1),
pb AS (SELECT DISTINCT station_id, warning_id, t_us FROM cl WHERE onset_us IS NULL),
pr AS (SELECT station_id, warning_id, unnest(range((t_us - 3599999999) + ((-(t_us - 3599999999)) % 600000000 + 600000000) % 600000000, t_us + 2400000001, 600000000)) AS slot_us FROM pb),
kn AS (SELECT pr.station_id, warning_id, count(*) = count(s.wet) AS known FROM pr LEFT JOIN s ON pr.station_id = s.station_id AND pr.slot_us = s.slot_us GROUP BY 1, 2),
rd AS (SELECT sid AS station_id, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY sid ORDER BY t_us) > 7200000000 THEN 1 ELSE 0 END AS nw FROM w),
rr AS (SELECT station_id, t_us, sum(nw) OVER (PARTITION BY station_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM rd),
ru AS (SELECT station_id, run, min(t_us) AS a, max(t_us) + 2400000000 AS b FROM rr GROUP BY 1, 2),
we AS (SELECT variant, cl.station_id, 'warning' AS side, cl.warning_id, t_us AS event_us, onset_us,
  CASE WHEN onset_us - t_us >= 300000000 THEN 'hit' WHEN onset_us IS NOT NULL THEN 'late' WHEN t_us + 2400000000 > until THEN 'pending' WHEN NOT known THEN 'unscorable' ELSE 'false_alarm' END AS outcome,
  eta_min - (onset_us - t_us) / 6e7 AS lead_error_min, all_clear_us FROM cl LEFT JOIN ku USING (station_id) LEFT JOIN kn ON kn.station_id = cl.station_id AND kn.warning_id = cl.warning_id),
vs AS (SELECT DISTINCT variant FROM sn),
oe AS (SELECT v.variant, ok.station_id, 'onset' AS side, cl.warning_id, ok.onset_us AS event_us, ok.onset_us,
  CASE WHEN cl.onset_us - cl.t_us >= 300000000 THEN 'hit' WHEN cl.t_us IS NOT NULL THEN 'miss_late' WHEN NOT EXISTS (SELECT 1 FROM ru WHERE ru.station_id = ok.station_id AND ok.onset_us BETWEEN ru.a AND ru.b) THEN 'uncovered'
   WHEN ok.onset_us + 600000000 > until THEN 'pending' ELSE 'miss' END AS outcome FROM vs v CROSS JOIN ok LEFT JOIN cl ON cl.variant = v.variant AND cl.station_id = ok.station_id AND cl.onset_us = ok.onset_us LEFT JOIN ku ON ku.station_id = ok.station_id),
ev AS (SELECT variant, station_id, side, warning_id, event_us, onset_us, outcome, lead_error_min,
  CASE WHEN all_clear_us IS NULL THEN NULL WHEN outcome IN ('pending', 'unscorable') THEN outcome WHEN outcome = 'false_alarm' THEN 'right' WHEN all_clear_us < onset_us THEN 'wrong' ELSE 'after_onset' END AS all_clear, (all_clear_us - event_us) / 6e7 AS clear_min FROM we
  UNION ALL SELECT variant, station_id, side, warning_id, event_us, onset_us, outcome, NULL, NULL, NULL FROM oe)"""


_SENT = "sn AS (SELECT 0.0::DOUBLE AS variant, sid AS station_id, warning_id, t_us, CASE WHEN NOT isnan(eta_min) THEN eta_min END AS eta_min, NULL::BIGINT AS all_clear_us FROM w)"


def summary_sql(by: str) -> str:
    rate = lambda a, b: f"{a} / nullif({b}, 0)::DOUBLE"
    p, r = rate("hits", "(hits + false_alarms)"), rate("hits", "(hits + misses + late)")
    f = lambda b: f"round({1 + b * b} * ({p}) * ({r}) / nullif({b * b} * ({p}) + ({r}), 0), 6)"
    n = lambda c, a: f"count(*) FILTER ({c}) AS {a}"
    w, o, g = "side = 'warning'", "side = 'onset'", "all_clear IN ('right', 'wrong', 'after_onset')"
    h = f"{w} AND outcome = 'hit' AND isfinite(lead_error_min)"
    counts = [
        n(w, "n_sent"), n(f"{w} AND outcome NOT IN ('pending', 'unscorable')", "warnings"), n(f"{w} AND outcome = 'hit'", "hits"), n(f"{w} AND outcome = 'late'", "late"), n("outcome = 'false_alarm'", "false_alarms"),
        n(f"{w} AND outcome = 'pending'", "pending"), n("outcome = 'unscorable'", "unscorable"), n(o, "n_onsets"), n("outcome = 'miss'", "misses"), n(f"{o} AND outcome = 'pending'", "pending_onsets"), n("outcome = 'uncovered'", "uncovered_onsets"),
        n(g, "all_clears"), n("all_clear = 'right'", "all_clears_right"), n("all_clear = 'wrong'", "all_clears_wrong"), n("all_clear = 'after_onset'", "all_clears_after_onset"), n("all_clear IN ('pending', 'unscorable')", "all_clears_pending"), n(h, "n_errors"),
        *[f"round(quantile_cont(lead_error_min, {q}) FILTER ({h}), 6) AS error_p{int(q * 100)}" for q in (0.25, 0.5, 0.75)], f"round(quantile_cont(clear_min, 0.5) FILTER ({g}), 6) AS all_clear_p50",
    ]
    return f"""(SELECT *, round({p}, 6) AS precision, round({r}, 6) AS recall, {f(0.5)} AS f05, {f(1)} AS f1, {f(2)} AS f2, round({rate("hits", "(hits + misses + late + false_alarms)")}, 6) AS csi, round({rate("false_alarms", "warnings")}, 6) AS far
 FROM (SELECT {by}, {", ".join(counts)} FROM ev GROUP BY ALL))"""


@query(f"WITH RECURSIVE {score_sql(_SENT)} SELECT station_id, side, warning_id, event_us, onset_us, outcome, round(lead_error_min, 6) AS lead_error_min FROM ev")
def matched_warnings(spark: SparkSession, base: str) -> DataFrame:
    """Warnings and onsets one to one in order of sending, each side with its outcome."""
    return r6(events(spark, base).drop("variant", "all_clear", "clear_min"), "lead_error_min")


def summary(e: DataFrame, by: list[str]) -> DataFrame:
    """``e`` should be cut: it is read three times."""
    s = matching.pooled_summary(e, by)
    return r6(s, "precision", "recall", "f05", "f1", "f2", "csi", "far", "error_p25", "error_p50", "error_p75", "all_clear_p50")


@query(f"WITH RECURSIVE {score_sql(_SENT)} SELECT * FROM {summary_sql('station_id')} UNION ALL SELECT * FROM {summary_sql('NULL AS station_id')}")
def warning_scoreboard(spark: SparkSession, base: str) -> DataFrame:
    """Counts, rates and quantiles per station and pooled over all (station null)."""
    e = cut(events(spark, base))
    return summary(e, ["station_id"]).unionByName(summary(e.withColumn("station_id", F.lit(None).cast("string")), ["station_id"]))


def decisions(spark: SparkSession, base: str) -> DataFrame:
    w = warnings(spark, base)
    return w.select("station_id", F.col("t_us").alias("us"), F.col("warning_id").alias("row_id"), F.col("p_rain").alias("p"), F.coalesce(F.col("eta_min") <= 1.5, F.lit(False)).alias("raining"))


def replay_sql(thresholds: list[int], gap_us: int = 7_200_000_000) -> str:
    """CTEs up to ``st``: the rule's state after every row, by recursion over the rows of a run."""
    return f"""dc AS (SELECT sid AS station_id, t_us AS us, warning_id AS row_id, p_rain AS p, coalesce(eta_min <= 1.5, false) AS raining FROM w),
d1 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY station_id ORDER BY us) > {gap_us} THEN 1 ELSE 0 END AS nw FROM dc),
d2 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY station_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM d1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY station_id, run ORDER BY us, row_id) AS k FROM d2),
st AS (SELECT DISTINCT t.thr, station_id, run, 0::BIGINT AS k, NULL::BIGINT AS row_id, NULL::BIGINT AS us, true AS armed, NULL::BIGINT AS below, NULL::BIGINT AS seen, false AS notified, 0 AS calm, false AS cleared, 'none' AS action, 0 AS streak
  FROM d3, (SELECT unnest({thresholds})::DOUBLE AS thr) t UNION ALL
 SELECT thr, station_id, run, k, row_id, us,
  CASE WHEN skip THEN armed WHEN fire THEN false ELSE arm END, CASE WHEN skip THEN below WHEN arm THEN NULL WHEN hot THEN NULL ELSE coalesce(below, us) END, CASE WHEN stale THEN seen ELSE us END,
  CASE WHEN skip THEN notified WHEN fire THEN NOT raining WHEN rearm THEN false ELSE notified END, CASE WHEN skip THEN calm WHEN fire OR rearm THEN 0 WHEN watch THEN ncalm ELSE calm END,
  CASE WHEN skip THEN cleared WHEN fire OR rearm THEN false ELSE cleared OR (watch AND ncalm >= 2) END,
  CASE WHEN skip THEN 'none' WHEN fire AND raining THEN 'already_raining' WHEN fire THEN 'notify' WHEN watch AND ncalm >= 2 THEN 'all_clear' ELSE 'none' END,
  CASE WHEN skip THEN streak WHEN NOT hot THEN 0 WHEN rearm THEN 1 ELSE streak + 1 END
 FROM (SELECT *, NOT skip AND arm AND hot AS fire, NOT skip AND NOT arm AND notified AND NOT cleared AS watch, CASE WHEN hot THEN 0 ELSE calm + 1 END AS ncalm FROM (
  SELECT *, stale OR p IS NULL OR isnan(p) AS skip, NOT (stale OR p IS NULL OR isnan(p)) AND NOT armed AND late AS rearm, armed OR late AS arm, p >= thr / 100.0 AS hot FROM (
   SELECT r.thr, r.station_id, r.run, d.k, d.row_id, d.us, d.p, d.raining, r.armed, r.below, r.seen, r.notified, r.calm, r.cleared, r.streak, coalesce(d.us <= r.seen, false) AS stale, coalesce(d.us - r.below >= 3600000000, false) AS late
   FROM st r JOIN d3 d ON d.station_id = r.station_id AND d.run = r.run AND d.k = r.k + 1))))"""


@query(f"WITH RECURSIVE {_WARN}, {replay_sql([40, 60, 80])} SELECT thr, station_id, row_id, us, run, action FROM st WHERE k > 0 AND action <> 'none'")
def replayed_actions(spark: SparkSession, base: str) -> DataFrame:
    """The notification rule over the recorded probabilities at three thresholds."""
    return matching.replay(decisions(spark, base), thresholds=[40, 60, 80])


@query(f"WITH RECURSIVE {_WARN}, {replay_sql([60])} SELECT thr, station_id, row_id, us, run, action, armed, streak, below AS below_us, notified, calm FROM st WHERE k > 0")
def replay_trace(spark: SparkSession, base: str) -> DataFrame:
    """Every decision with the rule's state after it."""
    return matching.replay(decisions(spark, base), thresholds=[60], traced=True)


def trace(spark: SparkSession, base: str) -> DataFrame:
    return matching.replay(decisions(spark, base), thresholds=[60], traced=True)


@query(
    f"""WITH RECURSIVE {_WARN}, {_SLOTS}, {_ONSETS}, {replay_sql([60])}, tr AS (SELECT station_id, us, row_id, armed, below, run, action FROM st WHERE k > 0),
j AS (SELECT n.station_id, n.onset_us, tr.us, tr.row_id, tr.armed, tr.below, tr.run, row_number() OVER (PARTITION BY n.station_id, n.onset_us ORDER BY tr.us DESC, tr.row_id DESC) AS k FROM n JOIN tr ON tr.station_id = n.station_id AND tr.us <= n.onset_us)
SELECT station_id, onset_us, us AS seen_us, CASE WHEN onset_us - us > 7200000000 THEN 'unwatched' WHEN armed OR coalesce(onset_us - below >= 3600000000, false) THEN 'armed' ELSE 'disarmed' END AS state FROM j WHERE k = 1"""
)
def arm_state_at_onsets(spark: SparkSession, base: str) -> DataFrame:
    """The rule's state as of each onset: from the last row by then; a re-arm that came due since counts; after a gap nobody watched."""
    on = G.onsets(slots(spark, base)).select("station_id", "onset_us")
    t = trace(spark, base).select("station_id", F.col("us").alias("at"), F.struct("us", "row_id", "armed", "below_us").alias("last"))
    j = B.last_before(on, t, key="station_id", left_us="onset_us", right_us="at", value="last", width=G.BLOCK_US).where("last is not null")
    late = F.coalesce(F.col("onset_us") - F.col("last.below_us") >= 3600 * MICROS, F.lit(False))
    state = F.when(F.col("onset_us") - F.col("last.us") > GAP * 60 * MICROS, "unwatched").when(F.col("last.armed") | late, "armed").otherwise("disarmed")
    return j.select("station_id", "onset_us", F.col("last.us").alias("seen_us"), state.alias("state"))


@query(
    f"""WITH RECURSIVE {_WARN}, {replay_sql([60])}, l AS (SELECT station_id, run, arg_max(armed, k) AS armed, max(us) AS us FROM st WHERE k > 0 GROUP BY 1, 2), f AS (SELECT station_id, run, min(us) AS us FROM st WHERE k > 0 GROUP BY 1, 2)
SELECT f.station_id, f.run, f.us AS from_us, f.us - l.us AS gap_us FROM f JOIN l ON l.station_id = f.station_id AND l.run = f.run - 1 WHERE NOT l.armed"""
)
def run_boundary_rearms(spark: SparkSession, base: str) -> DataFrame:
    """Runs that begin armed only because the state was dropped at the gap before them."""
    t = trace(spark, base)
    one = t.groupBy("station_id", "run").agg(F.max_by("armed", F.struct("us", "row_id")).alias("armed"), F.min("us").alias("a"), F.max("us").alias("b"))
    prev = one.select("station_id", (F.col("run") + 1).alias("run"), F.col("armed").alias("was"), F.col("b").alias("end"))
    return one.join(prev, ["station_id", "run"]).where("not was").select("station_id", "run", F.col("a").alias("from_us"), (F.col("a") - F.col("end")).alias("gap_us"))


@query(
    f"""WITH {_WARN}, d AS (SELECT sid AS station_id, t_us AS from_us, lead(t_us) OVER (PARTITION BY sid ORDER BY t_us) AS to_us FROM w)
SELECT station_id, from_us, to_us, (to_us - from_us) / 60000000.0::DOUBLE AS gap_min FROM d WHERE to_us - from_us > 7200000000"""
)
def decision_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Gaps of more than two hours between a station's decisions."""
    d = B.previous(warnings(spark, base).select("station_id", "t_us"), ["station_id"], "t_us", G.BLOCK_US)
    return d.where(F.col("t_us") - F.col("__prev") > GAP * 60 * MICROS).select("station_id", F.col("__prev").alias("from_us"), F.col("t_us").alias("to_us"), ((F.col("t_us") - F.col("__prev")) / F.lit(6e7)).alias("gap_min"))


_SWEEP = f"""{replay_sql(THRESHOLDS)}, pu AS (SELECT thr, station_id, row_id, us, action, lead(action) OVER v AS na, lead(us) OVER v AS nu FROM st WHERE action IN ('notify', 'all_clear') WINDOW v AS (PARTITION BY thr, station_id, run ORDER BY us)),
sn AS (SELECT thr AS variant, station_id, row_id AS warning_id, us AS t_us, CASE WHEN NOT isnan(e.eta_min) THEN e.eta_min END AS eta_min, CASE WHEN na = 'all_clear' THEN nu END AS all_clear_us FROM pu JOIN (SELECT warning_id, eta_min FROM w) e ON e.warning_id = pu.row_id WHERE action = 'notify')"""


@query(f"WITH RECURSIVE {score_sql(_SWEEP)} SELECT * FROM {summary_sql('variant AS thr')}")
def threshold_sweep(spark: SparkSession, base: str) -> DataFrame:
    """Every threshold replayed and scored against onsets with all outcomes; the rows and the onsets are shuffled once for all thresholds."""
    sent = matching.pushes(cut(matching.replay(decisions(spark, base), thresholds=THRESHOLDS))).withColumnRenamed("thr", "variant")
    sent = sent.join(warnings(spark, base).select("warning_id", F.when(~F.isnan("eta_min"), F.col("eta_min")).alias("eta_min")), "warning_id")
    return summary(cut(scored(spark, base, sent, variants=THRESHOLDS)), ["variant"]).withColumnRenamed("variant", "thr")


_CELLS = f"""{_V}, t AS (SELECT lead_min, CAST(i AS INTEGER) * 5 AS thr, p >= i * 0.05::DOUBLE AS pr, y > 0 AS ac FROM b, range(1, 20) q(i)),
c AS (SELECT lead_min, thr, count(*) FILTER (WHERE pr AND ac) AS h, count(*) FILTER (WHERE NOT pr AND ac) AS m, count(*) FILTER (WHERE pr AND NOT ac) AS f FROM t GROUP BY 1, 2),
s AS (SELECT *, round(2 * h / nullif(2 * h + m + f, 0)::DOUBLE, 6) AS f1, round(h / nullif(h + m + f, 0)::DOUBLE, 6) AS csi, round(h / nullif(h + m, 0)::DOUBLE, 6) AS pod, round(f / nullif(h + f, 0)::DOUBLE, 6) AS far FROM c)"""


def cells(spark: SparkSession, base: str) -> DataFrame:
    from slotweave.plans.reports import threshold_contingency

    return threshold_contingency(spark, base)


@query(
    f"""WITH {_CELLS}, pl AS (SELECT * FROM s WHERE f1 > 0 QUALIFY f1 >= 0.95 * max(f1) OVER (PARTITION BY lead_min)),
r AS (SELECT lead_min, min(thr) AS lo, max(thr) AS hi, least(greatest(CAST(floor((min(thr) + max(thr)) / 2.0 / 5 + 0.5) * 5 AS INTEGER), min(thr)), max(thr)) AS aim FROM pl GROUP BY 1),
k AS (SELECT pl.lead_min, lo, hi, thr, f1, row_number() OVER (PARTITION BY pl.lead_min ORDER BY abs(thr - aim), thr DESC) AS i FROM pl JOIN r USING (lead_min))
SELECT lead_min, lo, hi, thr AS pick, f1 FROM k WHERE i = 1"""
)
def pick_plateau(spark: SparkSession, base: str) -> DataFrame:
    """Thresholds within 5 % of the best F1; their rounded middle; the nearest measured cell, the higher on ties."""
    best = W.partitionBy("lead_min")
    pl = cells(spark, base).where("f1 > 0").withColumn("top", F.max("f1").over(best)).where("f1 >= 0.95 * top")
    pl = pl.withColumns({"lo": F.min("thr").over(best), "hi": F.max("thr").over(best)})
    aim = F.least(F.greatest((F.floor((F.col("lo") + F.col("hi")) / 2.0 / 5 + 0.5) * 5).cast("int"), F.col("lo")), F.col("hi"))
    k = F.row_number().over(best.orderBy(F.abs(F.col("thr") - aim), F.col("thr").desc()))
    return pl.withColumn("k", k).where("k = 1").select("lead_min", "lo", "hi", F.col("thr").alias("pick"), "f1")


@query(
    f"""WITH {_CELLS}, a AS (SELECT lead_min, thr, csi, row_number() OVER (PARTITION BY lead_min ORDER BY csi DESC NULLS LAST, thr DESC) AS i FROM s),
d AS (SELECT lead_min, thr, pod, far, row_number() OVER (PARTITION BY lead_min ORDER BY pod DESC NULLS LAST, thr DESC) AS i FROM s WHERE far <= 0.5)
SELECT a.lead_min, a.thr AS csi_pick, csi, d.thr AS pod_pick, pod, far FROM a LEFT JOIN d ON a.lead_min = d.lead_min AND d.i = 1 WHERE a.i = 1"""
)
def pick_extremes(spark: SparkSession, base: str) -> DataFrame:
    """The threshold of greatest CSI, and of greatest POD under a cap on the false-alarm ratio."""
    c = cells(spark, base)
    far_ok = F.col("far") <= 0.5
    a = c.groupBy("lead_min").agg(
        F.max(F.struct(F.coalesce("csi", F.lit(-1.0)).alias("v"), "thr")).alias("a"),
        F.max(F.when(far_ok, F.struct(F.coalesce("pod", F.lit(-1.0)).alias("v"), F.col("thr"), F.col("far")))).alias("d"),
    )
    return a.select("lead_min", F.col("a.thr").alias("csi_pick"), F.col("a.v").alias("csi"), F.col("d.thr").alias("pod_pick"), F.col("d.v").alias("pod"), F.col("d.far").alias("far"))


def minmax_sql(weight: str) -> str:
    """CTEs to ``f`` (lead_min, i, fitted): the fit at i is the greatest over a <= i of the least mean over a..z, z >= i."""
    return f"""d AS (SELECT lead_min, p, sum(w) AS sum_w, {weight} FROM b GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY lead_min ORDER BY p) AS i, sum(u) OVER (PARTITION BY lead_min ORDER BY p) AS cu, sum(u * m) OVER (PARTITION BY lead_min ORDER BY p) AS cm FROM d),
az AS (SELECT a.lead_min, a.i AS a, z.i AS z, (z.cm - a.cm + a.u * a.m) / (z.cu - a.cu + a.u) AS v FROM c a JOIN c z ON a.lead_min = z.lead_min AND z.i >= a.i),
mn AS (SELECT lead_min, a, z AS i, min(v) OVER (PARTITION BY lead_min, a ORDER BY z DESC) AS v FROM az),
f AS (SELECT lead_min, i, max(v) AS fitted FROM mn GROUP BY 1, 2)"""


@query(f"WITH {_V}, {minmax_sql('sum(w) AS u, sum(w * y) / sum(w) AS m')} SELECT c.lead_min, c.p, round(fitted, 6) AS fitted, round(sum_w, 6) AS sum_w FROM f JOIN c USING (lead_min, i)")
def isotonic_curve(spark: SparkSession, base: str) -> DataFrame:
    """Weighted isotonic fit per lead at its distinct probabilities (SQL twin: the min-max formula)."""
    return r6(calibration.isotonic(valid(spark, base), ["lead_min"]), "fitted", "sum_w")


@query(f"WITH {_V}, {minmax_sql('1.0::DOUBLE AS u, avg(y) AS m')} SELECT c.lead_min, c.p, round(fitted, 6) AS fitted, round(sum_w, 6) AS sum_w FROM f JOIN c USING (lead_min, i)")
def isotonic_unweighted(spark: SparkSession, base: str) -> DataFrame:
    """Every distinct probability counts alike, whatever its number of rows."""
    return r6(calibration.isotonic(valid(spark, base), ["lead_min"], weighted=False), "fitted", "sum_w")


@query(
    f"""WITH {_V}, x AS (SELECT lead_min, substr(event_time, 1, 10) AS fold, p, y, w FROM b), k AS (SELECT DISTINCT lead_min, fold FROM x),
d AS (SELECT k.lead_min, k.fold, x.p, sum(w) AS u, sum(w * y) / sum(w) AS m FROM k JOIN x ON x.lead_min = k.lead_min AND x.fold <> k.fold GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER g AS i, sum(u) OVER g AS cu, sum(u * m) OVER g AS cm FROM d WINDOW g AS (PARTITION BY lead_min, fold ORDER BY p)),
az AS (SELECT a.lead_min, a.fold, a.i AS a, z.i AS z, (z.cm - a.cm + a.u * a.m) / (z.cu - a.cu + a.u) AS v FROM c a JOIN c z ON a.lead_min = z.lead_min AND a.fold = z.fold AND z.i >= a.i),
mn AS (SELECT lead_min, fold, a, z AS i, min(v) OVER (PARTITION BY lead_min, fold, a ORDER BY z DESC) AS v FROM az), f AS (SELECT c.lead_min, c.fold, c.p, max(v) AS y FROM mn JOIN c USING (lead_min, fold, i) GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT lead_min, fold, p FROM x), lo AS (SELECT q.lead_min, q.fold, q.p, max(f.p) AS p0 FROM q JOIN f ON f.lead_min = q.lead_min AND f.fold = q.fold AND f.p <= q.p GROUP BY 1, 2, 3), hi AS (SELECT q.lead_min, q.fold, q.p, min(f.p) AS p1 FROM q JOIN f ON f.lead_min = q.lead_min AND f.fold = q.fold AND f.p >= q.p GROUP BY 1, 2, 3),
e AS (SELECT q.lead_min, q.fold, q.p, CASE WHEN p0 IS NULL THEN b1.y WHEN p1 IS NULL OR p1 = p0 THEN b0.y ELSE b0.y + (b1.y - b0.y) * (q.p - p0) / (p1 - p0) END AS cal FROM q LEFT JOIN lo USING (lead_min, fold, p) LEFT JOIN hi USING (lead_min, fold, p)
  LEFT JOIN f b0 ON b0.lead_min = q.lead_min AND b0.fold = q.fold AND b0.p = p0 LEFT JOIN f b1 ON b1.lead_min = q.lead_min AND b1.fold = q.fold AND b1.p = p1)
SELECT lead_min, count(cal) AS n, round(sum(w * (p - y) * (p - y)) / sum(w), 6) AS brier_raw, round(sum(w * (cal - y) * (cal - y)) / sum(CASE WHEN cal IS NOT NULL THEN w END), 6) AS brier_oof FROM x LEFT JOIN e USING (lead_min, fold, p) GROUP BY 1"""
)
def out_of_fold_brier(spark: SparkSession, base: str) -> DataFrame:
    """Leave one day out: curves from the other days, scores on the day; pooled per lead."""
    v = valid(spark, base).withColumn("fold", F.substring("event_time", 1, 10))
    folds = W.partitionBy("lead_min", "p")
    # sums of the other folds = all less own: no copy of the data per fold
    d = v.groupBy("lead_min", "fold", "p").agg(F.sum("w").alias("w_"), F.sum(F.col("w") * F.col("y")).alias("wy_"))
    keys = d.select("lead_min", "fold").distinct()
    alls = d.groupBy("lead_min", "p").agg(F.sum("w_").alias("aw"), F.sum("wy_").alias("ay"))
    train = keys.join(alls, "lead_min").join(d, ["lead_min", "fold", "p"], "left")
    train = train.select("lead_min", "fold", "p", (F.col("aw") - F.coalesce("w_", F.lit(0.0))).alias("w"), (F.col("ay") - F.coalesce("wy_", F.lit(0.0))).alias("wy")).where("w > 1e-9")
    curve = calibration.isotonic(train.withColumn("y", F.col("wy") / F.col("w")), ["lead_min", "fold"])
    c = calibration.apply_curve(v, curve, ["lead_min", "fold"])
    return r6(c.groupBy("lead_min").agg(F.count("calibrated").alias("n"), V.brier(F.col("w"), F.col("p"), F.col("y")).alias("brier_raw"), V.brier(F.when(F.col("calibrated").isNotNull(), F.col("w")), F.col("calibrated"), F.col("y")).alias("brier_oof")), "brier_raw", "brier_oof")


_DRAW = lambda *c: f"(CAST('0x' || substr(md5({' || chr(124) || '.join(c)}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(
    f"""WITH {_V}, d AS (SELECT lead_min, substr(event_time, 1, 10) AS day, sum(w * (p - y) * (p - y)) AS a, sum(w) AS g FROM b GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY lead_min ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY lead_min) AS n FROM d),
r AS (SELECT lead_min, n, i, CAST(s AS BIGINT) AS s, CAST(floor({_DRAW("'7'", "CAST(lead_min AS VARCHAR)", "CAST(s AS VARCHAR)", "CAST(i AS VARCHAR)")} * n) AS BIGINT) AS j FROM k, range(200) q(s)),
t AS (SELECT r.lead_min, r.s, sum(k.a) / sum(k.g) AS v FROM r JOIN k ON r.lead_min = k.lead_min AND r.j = k.i GROUP BY 1, 2)
SELECT lead_min, count(*) AS n_resamples, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.975), 6) AS hi FROM t GROUP BY 1"""
)
def brier_bootstrap(spark: SparkSession, base: str) -> DataFrame:
    """Day-block bootstrap of the Brier score with repeatable draws: days shrink to sums first, resamples draw days."""
    d = valid(spark, base).groupBy("lead_min", F.substring("event_time", 1, 10).alias("day")).agg(F.sum(F.col("w") * F.pow(F.col("p") - F.col("y"), 2)).alias("a"), F.sum("w").alias("g"))
    k = d.withColumn("i", F.row_number().over(W.partitionBy("lead_min").orderBy("day")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("lead_min")))
    r = k.select("lead_min", "n", "i", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("s"))
    r = r.withColumn("j", F.floor(V.hash_draw(F.col("lead_min"), F.col("s"), F.col("i"), seed=7) * F.col("n")))
    t = r.join(k.select("lead_min", F.col("i").alias("j"), "a", "g"), ["lead_min", "j"]).groupBy("lead_min", "s").agg((F.sum("a") / F.sum("g")).alias("v"))
    q = lambda x: F.round(F.percentile("v", F.lit(x)), 6)
    return t.groupBy("lead_min").agg(F.count(F.lit(1)).alias("n_resamples"), q(0.025).alias("lo"), q(0.5).alias("mid"), q(0.975).alias("hi"))


@query(
    """WITH c AS (SELECT outcome, count(*) AS n FROM warnings_scored GROUP BY 1), q AS (SELECT *, 100.0 * n / sum(n) OVER () AS quota FROM c),
f AS (SELECT *, floor(quota) AS base, row_number() OVER (ORDER BY quota - floor(quota) DESC, outcome) AS r, 100 - sum(floor(quota)) OVER () AS rest FROM q)
SELECT outcome, n, CAST(base + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f"""
)
def largest_remainder(spark: SparkSession, base: str) -> DataFrame:
    """A hundred places dealt in proportion to the classes, the rest by largest remainder."""
    c = table(spark, base, "warnings_scored").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))  # one row a class
    q = c.withColumn("quota", 100.0 * F.col("n") / F.sum("n").over(every)).withColumn("base", F.floor("quota"))
    q = q.withColumn("r", F.row_number().over(every.orderBy((F.col("quota") - F.col("base")).desc(), "outcome"))).withColumn("rest", 100 - F.sum("base").over(every))
    return q.select("outcome", "n", (F.col("base") + F.when(F.col("r") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("seats"))


@query(
    f"""WITH {_WARN}, k AS (SELECT sid AS station_id, outcome, warning_id, row_number() OVER (PARTITION BY sid, outcome ORDER BY md5('11|' || CAST(warning_id AS VARCHAR)), warning_id) AS r, count(*) OVER (PARTITION BY sid, outcome) AS n FROM w)
SELECT station_id, outcome, warning_id, round(n / least(n, 3)::DOUBLE, 6) AS weight FROM k WHERE r <= 3"""
)
def stratified_sample(spark: SparkSession, base: str) -> DataFrame:
    """Three warnings per station and outcome by a fixed hash, with inverse-inclusion weights (a sampling operator)."""
    cell = W.partitionBy("station_id", "outcome")
    k = warnings(spark, base).withColumn("h", F.md5(F.concat_ws("|", F.lit("11"), F.col("warning_id").cast("string"))))
    k = k.withColumn("r", F.row_number().over(cell.orderBy("h", "warning_id"))).withColumn("n", F.count(F.lit(1)).over(cell)).where("r <= 3")
    return k.select("station_id", "outcome", "warning_id", F.round(F.col("n") / F.least(F.col("n"), F.lit(3)), 6).alias("weight"))


@query(
    f"""WITH {_WARN}, k AS (SELECT warning_id, outcome, row_number() OVER (PARTITION BY outcome ORDER BY p_rain DESC NULLS LAST, warning_id) AS r, count(*) OVER (PARTITION BY outcome) AS n FROM w)
SELECT warning_id, outcome, least(10, (r - 1) * 10 // n + 1) AS decile FROM k"""
)
def review_deciles(spark: SparkSession, base: str) -> DataFrame:
    """Deciles by rank (not ntile): min(10, (rank - 1) * 10 div n + 1) within each outcome."""
    w = warnings(spark, base).select("warning_id", "outcome", "p_rain")
    stretch = F.struct(F.coalesce(-B.block_of(F.col("p_rain"), 1.0 / 1024), F.lit(1 << 40)).alias("p"), F.coalesce(-F.col("p_rain"), F.lit(float("inf"))).alias("x"), B.block_of(F.col("warning_id"), 100_000).alias("i"))
    r = B.running_sums(w, ["outcome"], [F.col("p_rain").desc_nulls_last(), F.col("warning_id")], stretch, {"r": F.lit(1)})
    n = w.groupBy(F.col("outcome").alias("o")).agg(F.count(F.lit(1)).alias("n"))  # one row a class
    j = r.join(n, F.col("outcome").eqNullSafe(F.col("o")))
    return j.select("warning_id", "outcome", F.least(F.lit(10).cast("long"), F.floor((F.col("r") - 1) * 10 / F.col("n")) + 1).alias("decile"))


@query(
    """WITH k AS (SELECT DISTINCT station_id || '|' || coalesce(name, '') AS k FROM station_catalogue WHERE station_id IS NOT NULL)
SELECT md5(count(*)::VARCHAR || '|' || coalesce(sum(CAST('0x' || substr(md5(k), 1, 12) AS BIGINT)), 0)::VARCHAR) AS h, count(*) AS n FROM k"""
)
def population_hash(spark: SparkSession, base: str) -> DataFrame:
    """Order-independent content hash of the station list: a sum of row hashes, so every task adds up its own."""
    k = table(spark, base, "station_catalogue").where("station_id is not null").select(F.concat_ws("|", "station_id", F.coalesce("name", F.lit(""))).alias("k")).distinct()
    part = F.conv(F.substring(F.md5("k"), 1, 12), 16, 10).cast("decimal(20,0)")
    one = k.agg(F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("s"), F.count(F.lit(1)).alias("n"))
    return one.select(F.md5(F.concat_ws("|", F.col("n").cast("string"), "s")).alias("h"), "n")


_GINI = lambda h, n: f"(CASE WHEN {n} > 0 THEN 2 * ({h} / {n}) * (1 - {h} / {n}) ELSE 0 END)"


@query(
    f"""WITH {_WARN}, r AS (SELECT CASE WHEN NOT isnan(p_rain) THEN p_rain END AS x, outcome = 'false_alarm' AS y FROM w WHERE outcome IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y)::DOUBLE AS h, count(*) FILTER (x IS NULL)::DOUBLE AS un, count(*) FILTER (x IS NULL AND y)::DOUBLE AS uh FROM r),
d AS (SELECT x, count(*) AS n, count(*) FILTER (y) AS h FROM r WHERE x IS NOT NULL GROUP BY 1),
c AS (SELECT x, (sum(n) OVER (ORDER BY x))::DOUBLE AS ln, (sum(h) OVER (ORDER BY x))::DOUBLE AS lh FROM d),
g AS (SELECT x, left_, ln + CASE WHEN left_ THEN un ELSE 0 END AS a, lh + CASE WHEN left_ THEN uh ELSE 0 END AS ah, n, h FROM c, t, (VALUES (true), (false)) q(left_)),
k AS (SELECT x, left_, ah / a > (h - ah) / (n - a) AS rich, {_GINI("h", "n")} - a / n * {_GINI("ah", "a")} - (n - a) / n * {_GINI("(h - ah)", "(n - a)")} AS gain FROM g WHERE a > 0 AND a < n)
SELECT x AS cut, CASE WHEN rich THEN '<=' ELSE '>' END AS direction, left_ = rich AS unknown_flagged, round(gain, 9) AS gain FROM k QUALIFY row_number() OVER (ORDER BY round(gain, 12) DESC, x, left_ DESC) = 1"""
)
def best_split(spark: SparkSession, base: str) -> DataFrame:
    """The single cut of the probability with the greatest Gini gain over its distinct values; rows without one are tried on both sides."""
    y = F.col("outcome") == "false_alarm"
    r = warnings(spark, base).where("outcome is not null").groupBy(V.finite_or_null(F.col("p_rain")).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(y).cast("double").alias("h"))
    t = r.agg(F.sum("n").alias("tn"), F.sum("h").alias("th"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0.0)).alias("un"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("h"))), F.lit(0.0)).alias("uh"))
    d = r.where("x is not null").withColumn("g", F.lit(1))
    c = B.running_sums(d, ["g"], [F.col("x")], B.block_of(F.col("x"), 1.0 / 1024), {"ln": F.col("n"), "lh": F.col("h")}).join(F.broadcast(t))  # t is one row
    c = c.withColumn("left", F.explode(F.array(F.lit(True), F.lit(False))))
    a, ah = F.col("ln") + F.when(F.col("left"), F.col("un")).otherwise(0.0), F.col("lh") + F.when(F.col("left"), F.col("uh")).otherwise(0.0)
    n, h = F.col("tn"), F.col("th")
    gini = lambda h, n: F.when(n > 0, 2 * (h / n) * (1 - h / n)).otherwise(0.0)
    gain = gini(h, n) - a / n * gini(ah, a) - (n - a) / n * gini(h - ah, n - a)
    k = c.where((a > 0) & (a < n)).select("x", "left", (ah / a > (h - ah) / (n - a)).alias("rich"), gain.alias("gain"))
    k = k.orderBy(F.round("gain", 12).desc(), "x", F.col("left").desc()).limit(1)
    return k.select(F.col("x").alias("cut"), F.when(F.col("rich"), "<=").otherwise(">").alias("direction"), (F.col("left") == F.col("rich")).alias("unknown_flagged"), F.round("gain", 9).alias("gain"))


@query(
    f"""WITH {_WARN}, e AS (SELECT outcome, CASE WHEN eta_min IS NULL THEN 'none' WHEN eta_min <= 10 THEN '0-10' WHEN eta_min <= 20 THEN '10-20' WHEN eta_min <= 30 THEN '20-30' WHEN eta_min <= 60 THEN '30-60' ELSE '60+' END AS bucket, CASE WHEN NOT isnan(lead_error_min) THEN lead_error_min END AS er FROM w)
SELECT bucket, count(er) AS n, round(quantile_cont(er, 0.5), 6) AS median, round(quantile_cont(abs(er), 0.5), 6) AS median_abs, round(quantile_cont(abs(er), 0.9), 6) AS p90_abs, round(avg(abs(er)), 6) AS mae, round(sqrt(avg(er * er)), 6) AS rmse,
 round(avg(CASE WHEN abs(er) <= 10 THEN 1.0 WHEN er IS NOT NULL THEN 0.0 END), 6) AS within_10 FROM e GROUP BY 1"""
)
def eta_error_table(spark: SparkSession, base: str) -> DataFrame:
    """Errors of the announced time per bucket of it."""
    e = F.col("eta_min")
    bucket = F.when(e.isNull(), "none").when(e <= 10, "0-10").when(e <= 20, "10-20").when(e <= 30, "20-30").when(e <= 60, "30-60").otherwise("60+")
    d = warnings(spark, base).select(bucket.alias("bucket"), V.finite_or_null(F.col("lead_error_min")).alias("er"))
    er = F.col("er")
    out = d.groupBy("bucket").agg(F.count("er").alias("n"), F.avg(F.abs(er)).alias("mae"), F.sqrt(F.avg(er * er)).alias("rmse"), F.avg(F.when(er.isNotNull(), (F.abs(er) <= 10).cast("double"))).alias("within_10"))
    a = V.quantiles(d, ["bucket"], "er", (0.5,), 4.0).select("bucket", F.col("q0").alias("median"))
    b = V.quantiles(d.withColumn("er", F.abs(er)), ["bucket"], "er", (0.5, 0.9), 4.0).select("bucket", F.col("q0").alias("median_abs"), F.col("q1").alias("p90_abs"))
    return r6(out.join(a, "bucket", "left").join(b, "bucket", "left"), "median", "median_abs", "p90_abs", "mae", "rmse", "within_10")


@query(
    f"""WITH {_V}, m AS (SELECT DISTINCT substr(event_time, 1, 10) AS fold FROM b), t AS (SELECT m.fold, lead_min, sum(w * y) / sum(w) AS base FROM b JOIN m ON substr(event_time, 1, 10) <> m.fold GROUP BY 1, 2)
SELECT t.fold, t.lead_min, count(*) AS n, round(t.base, 6) AS base_out, round(1 - sum(w * (p - y) * (p - y)) / nullif(sum(w * (t.base - y) * (t.base - y)), 0), 6) AS bss FROM b JOIN t ON substr(event_time, 1, 10) = t.fold AND b.lead_min = t.lead_min GROUP BY 1, 2, t.base"""
)
def leave_one_day_out(spark: SparkSession, base: str) -> DataFrame:
    """Skill of each day against the base rate of the other days: totals less own sums, no copy per fold."""
    v = valid(spark, base).withColumn("fold", F.substring("event_time", 1, 10))
    p, y, w = F.col("p"), F.col("y"), F.col("w")
    d = v.groupBy("fold", "lead_min").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"), F.sum(w * F.pow(p - y, 2)).alias("se"))
    a = W.partitionBy("lead_min")
    d = d.withColumn("base", (F.sum("swy").over(a) - F.col("swy")) / (F.sum("sw").over(a) - F.col("sw")))
    ref = F.col("swyy") - 2 * F.col("base") * F.col("swy") + F.pow("base", 2) * F.col("sw")
    return d.where("base is not null").select("fold", "lead_min", "n", F.round("base", 6).alias("base_out"), F.round(1 - V.ratio(F.col("se"), ref), 6).alias("bss"))
