"""Forecasts and decisions against gauge truth: the gauge-joined corpus, its reports, truth per lead, agreement by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import MICROS, convective_season, slot_end_us
from slotweave.operators import gauge as G
from slotweave.operators import spatial
from slotweave.operators import verification as V
from slotweave.plans.gauges import _ONSETS, _SLOTS, _WARN, slots, warnings
from slotweave.plans.problems import corpus_points, sites
from slotweave.plans.problems_sql import _KM, _POINTS, _STATIONS
from slotweave.plans.reports import corpus, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LEADS = (10, 20, 30, 45, 60)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def point_gauges(spark: SparkSession, base: str) -> DataFrame:
    """``point_id, station_id``: each corpus point's nearest present station within 5 km (of equally near ones the least id)."""
    near = spatial.match_sites(corpus_points(spark, base), sites(spark, base).where("kind = 'station'"))
    return near.groupBy("point_id").agg(F.min_by("found_id", F.struct("km", "found_id")).alias("station_id"))


def live_slots(spark: SparkSession, base: str) -> DataFrame:
    """Slots of gauges that are not dead (known a hundred times, never wet, while others were)."""
    s = slots(spark, base)
    k = s.groupBy("station_id").agg(F.count("wet").alias("n_known"), F.count_if(F.coalesce("wet", F.lit(False))).alias("n_wet"))
    any_wet = k.agg(F.max("n_wet").alias("top"))  # one row
    dead = k.join(F.broadcast(any_wet)).where("n_wet = 0 and n_known >= 100 and top > 0").select("station_id")
    return s.join(dead, "station_id", "left_anti")


def gauge_truth(spark: SparkSession, base: str) -> DataFrame:
    """Per (event, point, lead, target): gauge depth in the final slot and over the window, wet within the window, wet at its end; null without the final slot."""
    target = (F.ceil((F.col("lead_min") + F.greatest(F.col("frame_age_min").cast("double"), F.lit(0.0))) / 10.0 - 1e-9) * 10).cast("long")
    c = corpus(spark, base).where("frame_age_min is not null and not isnan(frame_age_min)")
    e = c.select("event_time", "point_id", "lead_min", F.unix_timestamp(F.to_timestamp("event_time")).alias("t"), target.alias("target")).distinct().join(point_gauges(spark, base), "point_id")
    p = e.withColumn("off", F.explode(F.sequence(F.lit(10).cast("long"), F.greatest(F.col("target"), F.lit(10)), F.lit(10).cast("long"))))
    p = p.withColumn("slot_us", (F.bround((F.col("t") + F.col("off") * 60) / 600.0) * 600 * MICROS).cast("long"))
    j = p.join(live_slots(spark, base).select("station_id", "slot_us", "mm", "wet"), ["station_id", "slot_us"], "left")
    last = F.col("off") == F.col("target")
    end = F.max(F.when(last, F.col("wet")))
    out = j.groupBy("event_time", "point_id", "lead_min", "target").agg(
        F.count("wet").alias("n_known"), F.sum("mm").alias("gauge_mm_window"), F.max(F.when(last, F.col("mm"))).alias("gauge_mm"),
        F.when(end.isNotNull(), F.max("wet").cast("int")).alias("gauge_outcome"), end.cast("int").alias("gauge_outcome_end"),
    )
    return out


_TRUTH = f"""{_SLOTS}, {_POINTS}, {_STATIONS},
pg AS (SELECT point_id, arg_min(station_id, (round(km, 9), station_id)) AS station_id FROM (SELECT pt.point_id, sa.station_id, {_KM("pt", "sa")} AS km FROM pt JOIN sa ON abs(pt.lat - sa.lat) < 0.1 AND {_KM("pt", "sa")} <= 5) GROUP BY 1),
dk AS (SELECT station_id, count(wet) AS n_known, count(*) FILTER (wet) AS n_wet FROM s GROUP BY 1),
ls AS (SELECT * FROM s WHERE station_id NOT IN (SELECT station_id FROM dk WHERE n_wet = 0 AND n_known >= 100 AND (SELECT max(n_wet) FROM dk) > 0)),
ce AS (SELECT *, CAST(ceil((lead_min + greatest(CAST(frame_age_min AS DOUBLE), 0)) / 10.0 - 1e-9) * 10 AS BIGINT) AS target FROM calibration_corpus WHERE frame_age_min IS NOT NULL AND NOT isnan(frame_age_min)),
te AS (SELECT DISTINCT event_time, ce.point_id, lead_min, station_id, epoch(CAST(event_time AS TIMESTAMPTZ)) AS t, target FROM ce JOIN pg ON ce.point_id = pg.point_id),
tp AS (SELECT te.*, unnest(range(10, greatest(target, 10) + 1, 10)) AS off FROM te),
tj AS (SELECT tp.*, ls.mm, ls.wet FROM tp LEFT JOIN ls ON tp.station_id = ls.station_id AND ls.slot_us = CAST(round_even((tp.t + off * 60) / 600.0, 0) AS BIGINT) * 600000000),
tr AS (SELECT event_time, point_id, lead_min, target, count(wet) AS n_known, sum(mm) AS gauge_mm_window, max(mm) FILTER (off = target) AS gauge_mm,
  CASE WHEN count(wet) FILTER (off = target) > 0 THEN CAST(bool_or(wet) AS INTEGER) END AS gauge_outcome, CAST(bool_or(wet) FILTER (off = target) AS INTEGER) AS gauge_outcome_end FROM tj GROUP BY 1, 2, 3, 4),
gc AS (SELECT ce.*, CAST(raw_prob AS DOUBLE) AS p, sample_weight AS w, CAST(outcome AS DOUBLE) AS yr, CAST(gauge_outcome AS DOUBLE) AS yg, gauge_mm, least(CAST(floor(raw_prob * 10) AS INTEGER), 9) AS bin
  FROM ce LEFT JOIN tr ON ce.event_time = tr.event_time AND ce.point_id = tr.point_id AND ce.lead_min = tr.lead_min AND ce.target = tr.target WHERE isfinite(raw_prob) AND isfinite(sample_weight) AND sample_weight > 0)"""


@query(f"WITH {_TRUTH} SELECT event_time, point_id, lead_min, target, n_known, round(gauge_mm_window, 6) AS gauge_mm_window, round(gauge_mm, 6) AS gauge_mm, gauge_outcome, gauge_outcome_end FROM tr")
def gauge_joined_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Corpus points with their nearest gauge's truth at the verification slots."""
    return r6(gauge_truth(spark, base), "gauge_mm_window", "gauge_mm")


def graded(spark: SparkSession, base: str) -> DataFrame:
    """Corpus rows with finite probability and weight, radar truth ``yr`` and gauge truth ``yg`` (each null if unknown), ``gauge_mm`` and ``bin``."""
    target = (F.ceil((F.col("lead_min") + F.greatest(F.col("frame_age_min").cast("double"), F.lit(0.0))) / 10.0 - 1e-9) * 10).cast("long")
    c = corpus(spark, base).where("frame_age_min is not null and not isnan(frame_age_min)").withColumn("target", target)
    c = c.where(V.finite(F.col("raw_prob")) & V.finite(F.col("sample_weight")) & (F.col("sample_weight") > 0))
    t = gauge_truth(spark, base).select("event_time", "point_id", "lead_min", "target", "gauge_mm", F.col("gauge_outcome").cast("double").alias("yg"))
    j = c.join(t, ["event_time", "point_id", "lead_min", "target"], "left")
    p = F.col("raw_prob").cast("double")
    return j.withColumns({"p": p, "w": F.col("sample_weight"), "yr": F.col("outcome").cast("double"), "bin": F.least(F.floor(p * 10).cast("int"), F.lit(9))})


@query(
    f"""WITH {_TRUTH} SELECT lead_min, bin, count(*) AS n, round(sum(w), 6) AS sum_w, round(sum(w) * sum(w) / sum(w * w), 6) AS eff_n, round(sum(w * p) / sum(w), 6) AS mean_p, round(sum(w * yg) / sum(w), 6) AS freq,
 round(avg(yg), 6) AS freq_plain, round(sum(w * coalesce(gauge_mm, 0)) / sum(w), 6) AS mean_gauge_mm FROM gc WHERE yg IS NOT NULL GROUP BY 1, 2"""
)
def reliability_gauge(spark: SparkSession, base: str) -> DataFrame:
    """Reliability against the gauges."""
    w = F.col("w")
    d = graded(spark, base).where("yg is not null").groupBy("lead_min", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sum_w"), V.kish(w).alias("eff_n"), V.ratio(F.sum(w * F.col("p")), F.sum(w)).alias("mean_p"), V.ratio(F.sum(w * F.col("yg")), F.sum(w)).alias("freq"), F.avg("yg").alias("freq_plain"),
        V.ratio(F.sum(w * F.coalesce("gauge_mm", F.lit(0.0))), F.sum(w)).alias("mean_gauge_mm"),
    )
    return r6(d, "sum_w", "eff_n", "mean_p", "freq", "freq_plain", "mean_gauge_mm")


@query(
    f"""WITH {_TRUTH}, sc AS (SELECT * FROM gc WHERE yr IS NOT NULL OR yg IS NOT NULL),
un AS (SELECT lead_min, bin, count(*) FILTER (yg IS NULL) AS n_radar_only, count(*) FILTER (yr IS NULL) AS n_gauge_only FROM sc GROUP BY 1, 2),
ag AS (SELECT lead_min, bin, count(*) AS n, sum(w) AS sw, sum(w) * sum(w) / sum(w * w) AS en, sum(w * p) / sum(w) AS mp, sum(w * yr) / sum(w) AS fr, sum(w * yg) / sum(w) AS fg FROM sc WHERE yr IS NOT NULL AND yg IS NOT NULL GROUP BY 1, 2)
SELECT lead_min, bin, n, round(sw, 6) AS sum_w, round(en, 6) AS eff_n, round(mp, 6) AS mean_p, round(fr, 6) AS freq_radar, round(fg, 6) AS freq_gauge, round(fg - fr, 6) + 0.0 AS gauge_minus_radar, coalesce(n_radar_only, 0) AS n_radar_only, coalesce(n_gauge_only, 0) AS n_gauge_only
FROM ag LEFT JOIN un USING (lead_min, bin) ORDER BY lead_min, gauge_minus_radar DESC NULLS LAST, bin"""
)
def reliability_radar_vs_gauge(spark: SparkSession, base: str) -> DataFrame:
    """Both truths on the rows that have both, with the counts of rows that have one: one aggregate with conditions instead of two and a join."""
    d = graded(spark, base).where("yr is not null or yg is not null")
    both = F.col("yr").isNotNull() & F.col("yg").isNotNull()
    w = F.when(both, F.col("w"))
    g = d.groupBy("lead_min", "bin").agg(
        F.count_if(both).alias("n"), F.sum(w).alias("sum_w"), V.kish(w).alias("eff_n"), V.ratio(F.sum(w * F.col("p")), F.sum(w)).alias("mean_p"), V.ratio(F.sum(w * F.col("yr")), F.sum(w)).alias("freq_radar"),
        V.ratio(F.sum(w * F.col("yg")), F.sum(w)).alias("freq_gauge"), F.count_if(F.col("yg").isNull()).alias("n_radar_only"), F.count_if(F.col("yr").isNull()).alias("n_gauge_only"),
    ).where("n > 0")
    g = g.withColumn("gauge_minus_radar", F.round(F.col("freq_gauge") - F.col("freq_radar"), 6) + 0.0)
    return r6(g, "sum_w", "eff_n", "mean_p", "freq_radar", "freq_gauge").orderBy("lead_min", F.col("gauge_minus_radar").desc_nulls_last(), "bin")


def lead_truth(spark: SparkSession, base: str) -> DataFrame:
    """Per warning and lead: rain in ``(t, t + lead]`` and an onset in ``(t, t + lead + 10]``, each with whether that can be told; all leads from one join with the slots of 70 minutes."""
    w = warnings(spark, base).select("warning_id", "station_id", "t_us", "p_rain")
    s = slots(spark, base)
    m = lambda k: F.lit(k * 60 * MICROS)
    probe = w.select("warning_id", "station_id", "t_us", F.explode(F.sequence(slot_end_us(F.col("t_us") + 1), F.col("t_us") + m(70), m(10))).alias("slot_us"))
    met = probe.join(s.select("station_id", "slot_us", "wet"), ["station_id", "slot_us"], "left")
    back = F.col("slot_us") - F.col("t_us")
    aggs = []
    for lead in LEADS:
        aggs += [F.max(F.when(back <= m(lead), F.col("wet"))).alias(f"w{lead}"), F.every(F.when(back <= m(lead), F.col("wet").isNotNull())).alias(f"k{lead}"), F.every(F.when(back <= m(lead + 10), F.col("wet").isNotNull())).alias(f"o{lead}")]
    g = met.groupBy("warning_id").agg(*aggs)
    nxt = G.as_of(w, G.onsets(s), key="station_id", left_us="t_us", right_us="onset_us", value="depth", row_id=["warning_id", "t_us", "p_rain"], within_min=70, forward=True, strict=True)
    j = nxt.join(g, "warning_id")
    one = lambda lead: F.struct(
        F.lit(lead).alias("lead_min"), F.when(F.col(f"w{lead}"), 1).when(F.col(f"k{lead}"), 0).alias("outcome"),
        F.coalesce(F.col("found_us") <= F.col("t_us") + m(lead + 10), F.lit(False)).alias("onset"), F.col(f"o{lead}").alias("all_known"),
    )
    long = j.select("warning_id", "p_rain", F.explode(F.array(*[one(x) for x in LEADS])).alias("x")).select("warning_id", "p_rain", "x.*")
    return long.select("warning_id", "p_rain", "lead_min", "outcome", F.when(F.col("onset"), 1).when(F.col("all_known"), 0).alias("onset_outcome"))


_LEAD_TRUTH = f"""{_WARN}, {_SLOTS}, {_ONSETS}, le AS (SELECT unnest({list(LEADS)})::BIGINT AS lead_min),
lp AS (SELECT warning_id, sid, t_us, p_rain, unnest(range((t_us + 1) + ((-(t_us + 1)) % 600000000 + 600000000) % 600000000, t_us + 4200000001, 600000000)) AS slot_us FROM w),
lj AS (SELECT lp.*, s.wet FROM lp LEFT JOIN s ON lp.sid = s.station_id AND lp.slot_us = s.slot_us),
lg AS (SELECT warning_id, sid, t_us, p_rain, lead_min, bool_or(wet) FILTER (slot_us - t_us <= lead_min * 60000000) AS anyw, bool_and(wet IS NOT NULL) FILTER (slot_us - t_us <= lead_min * 60000000) AS known, bool_and(wet IS NOT NULL) FILTER (slot_us - t_us <= (lead_min + 10) * 60000000) AS known10 FROM lj, le GROUP BY 1, 2, 3, 4, 5),
lt AS (SELECT warning_id, p_rain, lead_min, CASE WHEN anyw THEN 1 WHEN known THEN 0 END AS outcome, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.station_id = lg.sid AND n.onset_us > t_us AND n.onset_us <= t_us + (lead_min + 10) * 60000000) THEN 1 WHEN known10 THEN 0 END AS onset_outcome FROM lg)"""


@query(f"WITH {_LEAD_TRUTH} SELECT warning_id, CAST(lead_min AS INTEGER) AS lead_min, outcome, onset_outcome FROM lt")
def truth_per_lead(spark: SparkSession, base: str) -> DataFrame:
    """Rain and onset truth of every warning at five leads."""
    return lead_truth(spark, base).drop("p_rain")


@query(
    f"""WITH {_LEAD_TRUTH} SELECT lead_min, count(outcome) AS gradable, count(*) FILTER (outcome = 1) AS positives, count(*) FILTER (outcome IS NULL) AS excluded, round(avg(outcome), 6) AS base_rate,
 count(onset_outcome) AS onset_gradable, count(*) FILTER (onset_outcome = 1) AS onset_positives, round(avg(onset_outcome), 6) AS onset_base_rate FROM lt GROUP BY 1"""
)
def target_counts(spark: SparkSession, base: str) -> DataFrame:
    """What can be learnt from at each lead."""
    t = lead_truth(spark, base)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = t.groupBy("lead_min").agg(F.count("outcome").alias("gradable"), n(F.col("outcome") == 1).alias("positives"), n(F.col("outcome").isNull()).alias("excluded"), F.avg("outcome").alias("base_rate"),
                                  F.count("onset_outcome").alias("onset_gradable"), n(F.col("onset_outcome") == 1).alias("onset_positives"), F.avg("onset_outcome").alias("onset_base_rate"))
    return r6(g, "base_rate", "onset_base_rate")


@query(
    f"""WITH {_LEAD_TRUTH}, k AS (SELECT lead_min, least(CAST(floor(p_rain * 10) AS INTEGER), 9) AS bin, p_rain AS p, outcome AS y FROM lt WHERE outcome IS NOT NULL AND isfinite(p_rain))
SELECT lead_min, greatest(bin, 0) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS freq FROM k GROUP BY ALL"""
)
def decision_reliability(spark: SparkSession, base: str) -> DataFrame:
    """Served probabilities against the gauges, per lead."""
    t = lead_truth(spark, base).where(F.col("outcome").isNotNull() & V.finite(F.col("p_rain"))).withColumns({"p": F.col("p_rain"), "y": F.col("outcome").cast("double"), "w": F.lit(1.0)})
    return r6(V.reliability(t, ["lead_min"]).select("lead_min", "bin", "n", "mean_p", "freq"), "mean_p", "freq")


_AGREE = f"""{_WARN}, {_SLOTS}, a AS (SELECT w.*, s.wet, month(warned_at_utc) AS mon FROM w JOIN s ON w.sid = s.station_id AND s.slot_us = t_us + ((-t_us) % 600000000 + 600000000) % 600000000),
gg AS (SELECT *, unnest(['pooled', 'season ' || CASE WHEN mon BETWEEN 5 AND 9 THEN 'summer' WHEN mon IN (12, 1, 2, 3) THEN 'winter' ELSE 'shoulder' END, 'outcome ' || coalesce(outcome, 'unknown')]) AS grp FROM a),
m AS (SELECT grp, 'p_rain' AS series, thr / 100.0::DOUBLE AS threshold, p_rain >= thr / 100.0 AS fire, wet FROM gg, (SELECT unnest([25, 50, 75]) AS thr) WHERE isfinite(p_rain)
 UNION ALL SELECT grp, 'eta_min', -thr::DOUBLE, eta_min <= thr, wet FROM gg, (SELECT unnest([10, 20, 30]) AS thr) WHERE isfinite(eta_min))"""


def agreement_rows(spark: SparkSession, base: str) -> DataFrame:
    a = warnings(spark, base).withColumn("slot_us", slot_end_us(F.col("t_us"))).join(slots(spark, base).select("station_id", "slot_us", "wet"), ["station_id", "slot_us"])
    season = F.concat_ws(" ", F.lit("season"), convective_season(F.month("warned_at_utc")))
    return a.withColumn("grp", F.explode(F.array(F.lit("pooled"), season, F.concat_ws(" ", F.lit("outcome"), F.coalesce("outcome", F.lit("unknown"))))))


@query(
    f"""WITH {_AGREE} SELECT grp, series, threshold, count(*) FILTER (fire AND wet) AS hits, count(*) FILTER (NOT fire AND wet) AS misses, count(*) FILTER (fire AND NOT wet) AS false_alarms, count(*) FILTER (NOT fire AND NOT wet) AS correct FROM m GROUP BY 1, 2, 3"""
)
def agreement_by_group(spark: SparkSession, base: str) -> DataFrame:
    """Contingency of every series at every threshold in every group (rows may be in several): counts per row, no join of thresholds."""
    cut = lambda c, t, fire: F.struct(F.lit(c).alias("series"), F.lit(float(t)).alias("threshold"), F.when(V.finite(F.col(c)), fire).alias("fire"))
    p, e = F.col("p_rain"), F.col("eta_min")
    ways = [cut("p_rain", t / 100, p >= t / 100) for t in (25, 50, 75)] + [cut("eta_min", -t, e <= t) for t in (10, 20, 30)]
    m = agreement_rows(spark, base).select("grp", "wet", F.explode(F.array(*ways)).alias("x")).select("grp", "wet", "x.*").where("fire is not null")
    return m.groupBy("grp", "series", "threshold").agg(*V.contingency(F.col("fire"), F.col("wet")))


@query(
    f"""WITH {_AGREE} SELECT grp, wet, count(*) AS n, round(quantile_cont(p_rain, 0.1), 6) AS p10, round(quantile_cont(p_rain, 0.5), 6) AS p50, round(quantile_cont(p_rain, 0.9), 6) AS p90 FROM gg WHERE isfinite(p_rain) AND wet IS NOT NULL GROUP BY 1, 2"""
)
def conditional_quantiles(spark: SparkSession, base: str) -> DataFrame:
    """How the probability is spread over wet and dry slots, per group."""
    q = V.quantiles(agreement_rows(spark, base).where("wet is not null"), ["grp", "wet"], "p_rain", (0.1, 0.5, 0.9), 1.0 / 1024)
    return r6(q.withColumnsRenamed({"q0": "p10", "q1": "p50", "q2": "p90"}), "p10", "p50", "p90")


@query(
    f"""WITH {_AGREE} SELECT grp, count(*) AS n_rows, count(DISTINCT sid) AS n_stations, count(*) FILTER (isfinite(p_rain)) AS n_p_rain, count(*) FILTER (isfinite(eta_min)) AS n_eta, count(wet) AS n_gauge, count(*) FILTER (isfinite(p_rain) AND wet IS NOT NULL) AS n_both FROM gg GROUP BY 1"""
)
def agreement_coverage(spark: SparkSession, base: str) -> DataFrame:
    """What is there to compare, per group."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    p, e, wet = V.finite(F.col("p_rain")), V.finite(F.col("eta_min")), F.col("wet").isNotNull()
    return agreement_rows(spark, base).groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), n(p).alias("n_p_rain"), n(e).alias("n_eta"), F.count("wet").alias("n_gauge"), n(p & wet).alias("n_both"))
