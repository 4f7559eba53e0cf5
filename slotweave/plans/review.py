"""Queries of the event review: flags, shadows, radar truth, history, plans of frames, allocations, threshold documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions import geo, rain
from slotweave.functions.timeexpr import DAY_US, MICROS, convective_season, iso_utc_us
from slotweave.operators import blocks as B
from slotweave.operators import gauge as G
from slotweave.operators import sampling, spatial
from slotweave.operators import verification as V
from slotweave.operators.features import nearest_within
from slotweave.plans.fields import _BOX
from slotweave.plans.gauges import _SLOTS, _ST, _WARN, present, slots, warnings
from slotweave.plans.problems import corpus_points
from slotweave.plans.problems_sql import _KM, _POINTS
from slotweave.plans.reports import corpus, r6
from slotweave.plans.scoring import _CELLS, _DRAW, _SENT, cells, events, score_sql
from slotweave.runtime import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MIN = 60 * MICROS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH RECURSIVE {score_sql(_SENT)}, ms AS (SELECT station_id, onset_us FROM ev WHERE side = 'onset' AND outcome IN ('miss', 'uncovered')), hs AS (SELECT station_id, event_us, outcome FROM ev WHERE side = 'warning' AND outcome IN ('hit', 'late', 'false_alarm'))
SELECT station_id, count(*) AS n_missed, count(*) FILTER (EXISTS (SELECT 1 FROM hs WHERE hs.station_id = ms.station_id AND hs.outcome = 'hit' AND hs.event_us < ms.onset_us AND ms.onset_us <= hs.event_us + 3600000000)) AS behind_hits,
 count(*) FILTER (EXISTS (SELECT 1 FROM hs WHERE hs.station_id = ms.station_id AND hs.event_us < ms.onset_us AND ms.onset_us <= hs.event_us + 3600000000)) AS behind_any FROM ms GROUP BY 1"""
)
def shadowed_misses(spark: SparkSession, base: str) -> DataFrame:
    """Missed onsets in the hour after a warning, in which no second one could be sent."""
    e = cut(events(spark, base))
    m = e.where("side = 'onset' and outcome in ('miss', 'uncovered')").select("station_id", "onset_us")
    w = e.where("side = 'warning' and outcome in ('hit', 'late', 'false_alarm')").select("station_id", "event_us", "outcome")
    near = lambda d: G.as_of(m, d, key="station_id", left_us="onset_us", right_us="event_us", value="outcome", row_id=["station_id", "onset_us"], within_min=60, strict=True)
    a = near(w.where("outcome = 'hit'")).select("station_id", "onset_us", F.col("found_us").isNotNull().alias("hit"))
    b = near(w).select("station_id", "onset_us", F.col("found_us").isNotNull().alias("any"))
    return a.join(b, ["station_id", "onset_us"]).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_missed"), F.count_if("hit").alias("behind_hits"), F.count_if("any").alias("behind_any"))


@query(
    f"""WITH {_WARN} SELECT t_us // 86400000000 AS day, count(*) AS n_rows, count(eta_min) AS n_filled, count(*) - count(eta_min) > 0.05 * count(*) AS gap FROM w GROUP BY 1"""
)
def feature_gap_days(spark: SparkSession, base: str) -> DataFrame:
    """Days on which more than five in a hundred decisions lack their estimate."""
    g = warnings(spark, base).groupBy(B.block_of(F.col("t_us"), DAY_US).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("eta_min").alias("n_filled"))
    return g.withColumn("gap", F.col("n_rows") - F.col("n_filled") > 0.05 * F.col("n_rows"))


@query(
    f"""WITH {_SLOTS} SELECT station_id, strftime(make_timestamp(slot_us), '%Y-%m') AS month, count(wet) AS n_known, count(*) FILTER (wet) AS n_wet, count(wet) >= 100 AND count(*) FILTER (wet) = 0 AS suspect FROM s GROUP BY 1, 2"""
)
def suspect_months(spark: SparkSession, base: str) -> DataFrame:
    """Months in which a gauge reported often and was never wet."""
    g = slots(spark, base).groupBy("station_id", F.substring(iso_utc_us(F.col("slot_us")), 1, 7).alias("month")).agg(F.count("wet").alias("n_known"), F.count_if(F.coalesce("wet", F.lit(False))).alias("n_wet"))
    return g.withColumn("suspect", (F.col("n_known") >= 100) & (F.col("n_wet") == 0))


_RADAR = f"""{_WARN}, rw AS (SELECT sid AS station_id, t_us + ((-t_us) % 600000000 + 600000000) % 600000000 AS slot_us, p_rain * 4 / 6 AS v FROM w WHERE p_rain IS NOT NULL AND NOT isnan(p_rain)),
rf AS (SELECT station_id, slot_us, max(greatest(v, 0)) AS mm FROM rw GROUP BY 1, 2), rp AS (SELECT station_id, min(slot_us) AS a, max(slot_us) AS b FROM rf GROUP BY 1), rg AS (SELECT station_id, unnest(range(a, b + 1, 600000000)) AS slot_us FROM rp),
rs AS (SELECT rg.station_id, rg.slot_us, mm, mm >= 0.5 / 6 AS wet FROM rg LEFT JOIN rf USING (station_id, slot_us)),
rq AS (SELECT *, coalesce(sum(CASE WHEN NOT wet THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY slot_us ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS dry, coalesce(mm, 0) + coalesce(lead(mm) OVER (PARTITION BY station_id ORDER BY slot_us), 0) AS depth FROM rs)"""


@query(f"WITH {_RADAR} SELECT station_id, count(*) AS n_slots, count(wet) AS n_known, count(*) FILTER (wet) AS n_wet, count(*) FILTER (dry = 1 AND wet AND depth >= 0.2 - 1e-9) AS n_onsets, max(slot_us) AS known_until, round(max(depth), 6) AS deepest FROM rq GROUP BY 1")
def radar_truth(spark: SparkSession, base: str) -> DataFrame:
    """Truth by the decisions' own rates: greatest rate per slot on a contiguous grid, depth by its length, onsets by the gauges' rule with a dry spell of ten minutes."""
    w = warnings(spark, base).select("station_id", F.col("warned_at_utc").alias("observed_utc"), F.lit("precip_past10min").alias("parameter_id"), (F.col("p_rain") * 4 / 6).alias("value"))
    s = G.slot_amounts(w).withColumn("wet", F.col("mm") >= 0.5 / 6)
    o = G.onsets(s, dry_min=10).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_onsets"))
    w2 = W.partitionBy("station_id", "block").orderBy("slot_us")
    d = B.with_margin(s, "slot_us", G.BLOCK_US, 0, 10 * MIN).withColumn("depth", F.coalesce("mm", F.lit(0.0)) + F.coalesce(F.lead("mm").over(w2), F.lit(0.0))).where("core")
    k = d.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_slots"), F.count("wet").alias("n_known"), F.count_if(F.coalesce("wet", F.lit(False))).alias("n_wet"), F.max("slot_us").alias("known_until"), F.round(F.max("depth"), 6).alias("deepest"))
    return k.join(o, "station_id", "left").withColumn("n_onsets", F.coalesce("n_onsets", F.lit(0)))


@query(
    f"""WITH {_WARN}, k AS (SELECT warning_id, sid, t_us, p_rain * 4 AS r FROM w), x AS (SELECT a.warning_id, max(CASE WHEN b.t_us >= a.t_us - 3600000000 AND b.t_us < a.t_us THEN b.r END) AS prev60, max(b.t_us) FILTER (b.r >= 2.0) AS w1, max(b.t_us) FILTER (b.r >= 0.8) AS w2, any_value(a.t_us) AS t
 FROM k a LEFT JOIN k b ON a.sid = b.sid AND b.t_us <= a.t_us AND b.t_us >= a.t_us - 10800000000 GROUP BY 1)
SELECT warning_id, round(prev60, 6) AS prev60_max, round(coalesce(least((t - w1) / 6e7, 180), 180), 6) AS min_since_rain, round(coalesce(least((t - w2) / 6e7, 180), 180), 6) AS min_since_echo FROM x"""
)
def decision_history(spark: SparkSession, base: str) -> DataFrame:
    """The point's own past at each decision: greatest rate of the hour before, minutes since rain and since echo (at most 180); blocks with three hours as margin."""
    k = warnings(spark, base).select("warning_id", "station_id", "t_us", (F.col("p_rain") * 4).alias("r"))
    d = B.with_margin(k, "t_us", G.BLOCK_US, 180 * MIN)
    w = W.partitionBy("station_id", "block").orderBy("t_us")
    back = w.rangeBetween(-180 * MIN, 0)
    since = lambda cutoff: F.round(F.coalesce(F.least((F.col("t_us") - F.max(F.when(F.col("r") >= cutoff, F.col("t_us"))).over(back)) / F.lit(6e7), F.lit(180.0)), F.lit(180.0)), 6)
    out = d.withColumns({"prev60_max": F.round(F.max("r").over(w.rangeBetween(-60 * MIN, -1)), 6), "min_since_rain": since(2.0), "min_since_echo": since(0.8)})
    return out.where("core").select("warning_id", "prev60_max", "min_since_rain", "min_since_echo")


@query(
    f"""WITH {_WARN}, {_SLOTS}, gd AS (SELECT t_us // 86400000000 AS day FROM w GROUP BY 1 HAVING count(*) - count(eta_min) > 0.05 * count(*)), sm AS (SELECT station_id, strftime(make_timestamp(slot_us), '%Y-%m') AS month FROM s GROUP BY 1, 2 HAVING count(wet) >= 100 AND count(*) FILTER (wet) = 0),
pb AS (SELECT warning_id, sid, unnest(range((t_us - 3599999999) + ((-(t_us - 3599999999)) % 600000000 + 600000000) % 600000000, t_us + 3600000001, 600000000)) AS slot_us FROM w), gp AS (SELECT warning_id FROM pb LEFT JOIN s ON pb.sid = s.station_id AND pb.slot_us = s.slot_us GROUP BY 1 HAVING count(s.wet) < count(*)),
dp AS (SELECT sid, t_us FROM w GROUP BY 1, 2 HAVING count(*) > 1)
SELECT w.warning_id, array_to_string(list_filter([CASE WHEN gd.day IS NOT NULL THEN 'feature_gap' END, CASE WHEN sm.month IS NOT NULL THEN 'suspect_month' END, CASE WHEN gp.warning_id IS NOT NULL THEN 'gauge_gap' END, CASE WHEN dp.sid IS NOT NULL THEN 'repeated' END, CASE WHEN eta_min IS NULL THEN 'no_eta' END], lambda x: x IS NOT NULL), ',') AS flags
FROM w LEFT JOIN gd ON gd.day = t_us // 86400000000 LEFT JOIN sm ON sm.station_id = w.sid AND sm.month = strftime(make_timestamp(t_us), '%Y-%m') LEFT JOIN gp ON gp.warning_id = w.warning_id LEFT JOIN dp ON dp.sid = w.sid AND dp.t_us = w.t_us"""
)
def event_flags(spark: SparkSession, base: str) -> DataFrame:
    """What speaks against judging a warning: flags of its day, month, window and key."""
    w = warnings(spark, base).withColumns({"day": B.block_of(F.col("t_us"), DAY_US), "month": F.substring(iso_utc_us(F.col("t_us")), 1, 7)})
    s = slots(spark, base)
    gaps = feature_gap_days(spark, base).where("gap").select("day", F.lit("feature_gap").alias("f1"))
    months = suspect_months(spark, base).where("suspect").select("station_id", "month", F.lit("suspect_month").alias("f2"))
    probe = w.select("warning_id", "station_id", F.explode(F.sequence(F.col("t_us") - F.lit(60 * MIN) + 1 + F.pmod(-(F.col("t_us") - F.lit(60 * MIN) + 1), F.lit(10 * MIN)), F.col("t_us") + F.lit(60 * MIN), F.lit(10 * MIN))).alias("slot_us"))
    hole = probe.join(s.select("station_id", "slot_us", "wet"), ["station_id", "slot_us"], "left").groupBy("warning_id").agg(F.when(F.count("wet") < F.count(F.lit(1)), "gauge_gap").alias("f3"))
    twice = w.groupBy("station_id", "t_us").agg(F.when(F.count(F.lit(1)) > 1, "repeated").alias("f4"))
    j = w.join(gaps, "day", "left").join(months, ["station_id", "month"], "left").join(hole, "warning_id", "left").join(twice, ["station_id", "t_us"], "left")
    return j.select("warning_id", F.concat_ws(",", "f1", "f2", "f3", "f4", F.when(F.col("eta_min").isNull(), "no_eta")).alias("flags"))


@query(
    f"""WITH {_WARN}, st_ AS (SELECT DISTINCT unnest(range(t_us - 5400000000 + ((-(t_us - 5400000000)) % 600000000 + 600000000) % 600000000, t_us + 3600000001, 600000000)) AS f FROM w) SELECT f // 86400000000 AS day, count(*) AS n_frames, min(f) AS first_us, max(f) AS last_us FROM st_ GROUP BY 1"""
)
def frame_plan(spark: SparkSession, base: str) -> DataFrame:
    """The frames all reviewed windows need together, each once, by day."""
    lo = F.col("t_us") - F.lit(90 * MIN)
    f = warnings(spark, base).select(F.explode(F.sequence(lo + F.pmod(-lo, F.lit(10 * MIN)), F.col("t_us") + F.lit(60 * MIN), F.lit(10 * MIN))).alias("f")).distinct()
    return f.groupBy(B.block_of(F.col("f"), DAY_US).alias("day")).agg(F.count(F.lit(1)).alias("n_frames"), F.min("f").alias("first_us"), F.max("f").alias("last_us"))


@query(
    f"""WITH {_WARN}, {_ST}, e AS (SELECT outcome, month(warned_at_utc) AS mon, {_BOX.replace('lat ', 'st.lat ').replace('lon ', 'st.lon ')} AS region, p_rain * 6 AS r, p_rain FROM w LEFT JOIN st ON w.sid = st.station_id)
SELECT outcome, CASE WHEN mon BETWEEN 5 AND 9 THEN 'summer' WHEN mon IN (12, 1, 2, 3) THEN 'winter' ELSE 'shoulder' END AS season, region, CASE WHEN r IS NULL OR NOT isfinite(r) THEN 'unknown' WHEN r < 0.5 THEN 'trace' WHEN r < 1 THEN 'light' WHEN r < 4 THEN 'moderate' ELSE 'heavy' END AS band, count(*) AS n, round(avg(p_rain), 6) AS mean_p FROM e GROUP BY 1, 2, 3, 4"""
)
def event_population(spark: SparkSession, base: str) -> DataFrame:
    """Warnings by outcome, season, region and band: the cells a review samples from."""
    e = warnings(spark, base).join(present(spark, base), "station_id", "left")
    g = e.groupBy("outcome", convective_season(F.month("warned_at_utc")).alias("season"), geo.region_box(F.col("lat"), F.col("lon")).alias("region"), rain.intensity_band(F.col("p_rain") * 6).alias("band"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_rain"), 6).alias("mean_p"))


@query(
    f"""WITH {_WARN}, c AS (SELECT coalesce(outcome, 'none') || '|' || sid AS cell, count(*) AS n FROM w GROUP BY 1),
f AS (SELECT *, greatest(0, least(least(5, n), 400 - coalesce(sum(least(5, n)) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got FROM c),
g AS (SELECT *, n - got AS room, least(400 - sum(got) OVER (), sum(n - got) OVER ()) AS share, sum(n - got) OVER () AS free FROM f), q AS (SELECT *, CASE WHEN free > 0 THEN share * room / free::DOUBLE ELSE 0 END AS quota FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, cell) AS k, share - sum(floor(quota)) OVER () AS rest FROM q)
SELECT cell, n, CAST(got + floor(quota) + CASE WHEN k <= rest AND floor(quota) < room THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r"""
)
def allocated_seats(spark: SparkSession, base: str) -> DataFrame:
    """Four hundred places over the cells of outcome and station: five each first, the rest by free room and largest remainder, never more than a cell holds."""
    c = warnings(spark, base).groupBy(F.concat_ws("|", F.coalesce("outcome", F.lit("none")), "station_id").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.allocate(c, "cell", "n", total=400, floor=5)


@query(
    f"""WITH d AS (SELECT DISTINCT substr(event_time, 1, 10) AS day FROM calibration_corpus), p AS (SELECT *, substr(day, 1, 7) AS month, row_number() OVER (PARTITION BY substr(day, 1, 7) ORDER BY md5('5|' || day), day) AS k FROM d),
m AS (SELECT month, count(*) AS n FROM p GROUP BY 1), b AS (SELECT unnest([2, 5, 9]) AS budget), q AS (SELECT budget, month, n, least(budget, sum(n) OVER w) * n / (sum(n) OVER w)::DOUBLE AS quota, least(budget, sum(n) OVER w) AS share FROM m, b WINDOW w AS (PARTITION BY budget)),
r AS (SELECT *, floor(quota) + CASE WHEN row_number() OVER (PARTITION BY budget ORDER BY round(quota - floor(quota), 9) DESC, month) <= share - sum(floor(quota)) OVER (PARTITION BY budget) THEN 1 ELSE 0 END AS take FROM q)
SELECT CAST(budget AS INTEGER) AS budget, r.month, day FROM r JOIN p ON p.month = r.month AND p.k <= r.take"""
)
def drawn_days(spark: SparkSession, base: str) -> DataFrame:
    """Training days by budget: each month's days in a fixed random order, budgets dealt to months by largest remainder, so larger draws hold the smaller ones of a month."""
    d = corpus(spark, base).select(F.substring("event_time", 1, 10).alias("day")).distinct().withColumn("month", F.substring("day", 1, 7))
    p = d.withColumn("k", F.row_number().over(W.partitionBy("month").orderBy(F.md5(F.concat_ws("|", F.lit("5"), "day")), "day")))
    m = p.groupBy("month").agg(F.count(F.lit(1)).alias("n")).withColumn("budget", F.explode(F.array(F.lit(2), F.lit(5), F.lit(9))))
    return sampling.allocate(m, "month", "n", total=F.col("budget"), floor=0, by=["budget"]).withColumnRenamed("n", "size").join(p, "month").where("k <= seats").select("budget", "month", "day")


@query(
    f"""WITH {_WARN}, k AS (SELECT sid AS station_id, t_us FROM w WHERE month(warned_at_utc) IN (8) OR strftime(CAST(warned_at_utc AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m') IN ('2026-06')), d AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY station_id ORDER BY t_us) > 7200000000 THEN 1 ELSE 0 END AS nw FROM k),
r AS (SELECT *, sum(nw) OVER (PARTITION BY station_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d) SELECT station_id, CAST(run AS BIGINT) AS run, min(t_us) AS from_us, max(t_us) AS to_us, count(*) AS n FROM r GROUP BY 1, 2"""
)
def runs_in_months(spark: SparkSession, base: str) -> DataFrame:
    """Coverage runs of the decisions of chosen months (of any year, or of one year), numbered anew."""
    w = warnings(spark, base).where(in_months(F.col("warned_at_utc"), [8], ["2026-06"]))
    return G.coverage_runs(w, "station_id", F.col("t_us"), gap_min=120)


def in_months(ts: Column, plain: list[int], pairs: list[str]) -> Column:
    """Whether an instant lies in one of the months, given plain or as ``yyyy-MM``."""
    return F.month(ts).isin(plain) | F.date_format(ts, "yyyy-MM").isin(pairs)


_FRAMES = "fr AS (SELECT DISTINCT scan_type, epoch_us(CAST(event_time AS TIMESTAMPTZ)) AS us FROM calibration_corpus WHERE scan_type IS NOT NULL)"


def frames(spark: SparkSession, base: str) -> DataFrame:
    return corpus(spark, base).where("scan_type is not null").select("scan_type", (F.unix_timestamp(F.to_timestamp("event_time")) * MICROS).alias("us")).distinct()


@query(
    f"""WITH {_FRAMES}, n1 AS (SELECT a.scan_type, a.us, arg_min(b.us, (abs(b.us - (a.us - 3600000000)), b.us)) AS p FROM fr a JOIN fr b ON a.scan_type = b.scan_type AND abs(b.us - (a.us - 3600000000)) <= 1800000000 GROUP BY 1, 2),
n2 AS (SELECT a.scan_type, a.us, arg_min(b.us, (abs(b.us - (a.us - 7200000000)), b.us)) AS p FROM fr a JOIN fr b ON a.scan_type = b.scan_type AND abs(b.us - (a.us - 7200000000)) <= 1800000000 GROUP BY 1, 2)
SELECT fr.scan_type, fr.us, n1.p AS back_1, n2.p AS back_2, n1.p IS NOT NULL AND n2.p IS NOT NULL AS complete FROM fr LEFT JOIN n1 USING (scan_type, us) LEFT JOIN n2 USING (scan_type, us)"""
)
def anchor_history(spark: SparkSession, base: str) -> DataFrame:
    """Each frame with the frames of its kind nearest to one and two hours before, within half an hour."""
    f = frames(spark, base)
    held = f.select("scan_type", F.col("us").alias("r"))

    def back(k: int) -> DataFrame:
        left = f.withColumn("aim", F.col("us") - F.lit(k * 60 * MIN))
        return nearest_within(left, held.withColumn("v", F.col("r")), key="scan_type", left_us="aim", right_us="r", value="v", row_id=["scan_type", "us"], within_min=30).select("scan_type", "us", F.col("found_us").alias(f"back_{k}"))

    return back(1).join(back(2), ["scan_type", "us"]).withColumn("complete", F.col("back_1").isNotNull() & F.col("back_2").isNotNull())


@query(
    f"""WITH {_FRAMES}, b AS (SELECT min(us) AS a, max(us) + 7200000000 AS z FROM fr), po AS (SELECT unnest(range(a // 300000000 * 300000000, z + 1, 300000000)) AS g FROM b),
pj AS (SELECT g + CAST(floor({_DRAW("'13'", "CAST(g AS VARCHAR)")} * 60) AS BIGINT) * 1000000 AS now FROM po), lg AS (SELECT *, CASE scan_type WHEN 'fullRange' THEN 786000000 ELSE 486000000 END AS lag FROM fr),
k AS (SELECT now, us, scan_type, row_number() OVER (PARTITION BY now ORDER BY us DESC, scan_type DESC) AS r FROM pj JOIN lg ON us + lag <= now AND now - us <= 3600000000)
SELECT scan_type, us AS anchor_us, min(now) AS decided_us, (min(now) - us) / 6e7 AS age_min FROM k WHERE r = 1 GROUP BY 1, 2"""
)
def decision_instants(spark: SparkSession, base: str) -> DataFrame:
    """When a poll every five minutes (with a fixed jitter) first sees each newest published frame, and how old it is then."""
    f = frames(spark, base).withColumn("lag", F.when(F.col("scan_type") == "fullRange", F.lit(786 * MICROS)).otherwise(F.lit(486 * MICROS)))
    step = F.lit(5 * MIN)
    span = f.agg(F.min("us").alias("a"), (F.max("us") + F.lit(120 * MIN)).alias("z"))
    days = span.select("z", F.explode(F.sequence(F.floor(F.col("a") / step) * step, F.col("z"), F.lit(DAY_US))).alias("d"))  # the grid is spread by day
    g = days.select("z", F.explode(F.sequence(F.col("d"), F.col("d") + F.lit(DAY_US - 5 * MIN), step)).alias("g")).where("g <= z").select("g")
    p = g.select((F.col("g") + F.floor(V.hash_draw(F.col("g"), seed=13) * 60) * MICROS).alias("now"))
    hour = F.lit(60 * MIN)
    b = F.floor(F.col("now") / hour)
    j = p.select("now", F.explode(F.array(b - 1, b)).alias("b")).join(f.withColumn("b", F.floor(F.col("us") / hour)), "b")
    ok = j.where((F.col("us") + F.col("lag") <= F.col("now")) & (F.col("now") - F.col("us") <= hour))
    best = ok.groupBy("now").agg(F.max(F.struct("us", "scan_type")).alias("m"))
    return best.groupBy(F.col("m.scan_type").alias("scan_type"), F.col("m.us").alias("anchor_us")).agg(F.min("now").alias("decided_us")).withColumn("age_min", (F.col("decided_us") - F.col("anchor_us")) / F.lit(6e7))


@query("""WITH c AS (SELECT scan_type, CAST(frame_age_min AS DOUBLE) AS a FROM calibration_corpus WHERE isfinite(frame_age_min)) SELECT scan_type, count(*) AS n, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.5), 6) AS p50, round(quantile_cont(a, 0.9), 6) AS p90, round(max(a), 6) AS worst FROM c GROUP BY 1""")
def frame_age_stats(spark: SparkSession, base: str) -> DataFrame:
    """How stale the frames were."""
    c = corpus(spark, base).where(V.finite(F.col("frame_age_min"))).select("scan_type", F.col("frame_age_min").cast("double").alias("a"))
    q = V.quantiles(c, ["scan_type"], "a", (0.5, 0.9, 1.0), 1.0).withColumnsRenamed({"q0": "p50", "q1": "p90", "q2": "worst", "scan_type": "k"})
    m = c.groupBy("scan_type").agg(F.avg("a").alias("mean"))
    return r6(m.join(q, F.col("scan_type").eqNullSafe(F.col("k"))).select("scan_type", "n", "mean", "p50", "p90", "worst"), "mean", "p50", "p90", "worst")


@query(f"""WITH {_FRAMES}, d AS (SELECT us // 86400000000 AS day, us - lag(us) OVER (PARTITION BY us // 86400000000 ORDER BY us) AS gap FROM (SELECT DISTINCT us FROM fr)) SELECT day, count(*) AS n, coalesce(bool_and(gap <= 3600000000), true) AS contiguous, CAST(max(gap) AS BIGINT) AS widest_us FROM d GROUP BY 1""")
def contiguous_days(spark: SparkSession, base: str) -> DataFrame:
    """Days whose frames follow each other within an hour."""
    f = frames(spark, base).select("us").distinct().withColumn("day", B.block_of(F.col("us"), DAY_US))
    d = f.withColumn("gap", F.col("us") - F.lag("us").over(W.partitionBy("day").orderBy("us")))
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.every(F.col("gap") <= 60 * MIN), F.lit(True)).alias("contiguous"), F.max("gap").alias("widest_us"))


@query(
    f"""WITH {_POINTS}, {_ST}, kd AS (SELECT pt.point_id, min({_KM("pt", "st")}) AS km FROM pt CROSS JOIN st GROUP BY 1), bn AS (SELECT point_id, CASE WHEN km < 5 THEN 5 WHEN km < 10 THEN 10 WHEN km < 20 THEN 20 WHEN km < 40 THEN 40 END AS bin FROM kd WHERE km <= 40),
v AS (SELECT bin, avg(pow(CAST(raw_prob AS DOUBLE) - outcome, 2)) AS brier, count(*) AS n FROM calibration_corpus c JOIN bn USING (point_id) WHERE isfinite(raw_prob) AND outcome IS NOT NULL AND bin IS NOT NULL GROUP BY 1), p AS (SELECT bin, count(DISTINCT point_id) AS points FROM bn WHERE bin IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_bins, CAST(sum(points) AS BIGINT) AS points, round(sum(points * brier) / sum(CASE WHEN brier IS NOT NULL THEN points END), 6) AS expected FROM p LEFT JOIN v USING (bin)"""
)
def expected_at_random_point(spark: SparkSession, base: str) -> DataFrame:
    """The score by distance to the nearest station, weighed by how many points lie so far from one; bins without a score carry no weight."""
    p = corpus_points(spark, base)
    st = present(spark, base)
    null = F.lit(None).cast("array<array<double>>")
    circles = st.select(F.lit("station").alias("kind"), F.col("station_id").alias("id"), "lat", "lon", F.lit(40.0).alias("km"), null.alias("rings_lon"), null.alias("rings_lat"))
    km = spatial.match_sites(p, circles).groupBy("point_id").agg(F.min("km").alias("km"))
    k = F.col("km")
    b = km.select("point_id", F.when(k < 5, 5).when(k < 10, 10).when(k < 20, 20).when(k < 40, 40).alias("bin")).where("bin is not null")
    c = corpus(spark, base).where(V.finite(F.col("raw_prob")) & F.col("outcome").isNotNull()).join(b, "point_id")
    v = c.groupBy("bin").agg(F.avg(F.pow(F.col("raw_prob").cast("double") - F.col("outcome"), 2)).alias("brier"))
    j = b.groupBy("bin").agg(F.countDistinct("point_id").alias("points")).join(v, "bin", "left")
    return j.agg(F.count(F.lit(1)).alias("n_bins"), F.sum("points").alias("points"), F.round(F.sum(F.col("points") * F.col("brier")) / F.sum(F.when(F.col("brier").isNotNull(), F.col("points"))), 6).alias("expected"))


@query(
    f"""WITH {_CELLS}, pk AS (SELECT lead_min, thr FROM s WHERE f1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lead_min ORDER BY f1 DESC, thr DESC) = 1), a AS (SELECT unnest([5, 10, 20, 30, 45, 60, 90]) AS lead_min)
SELECT CAST(a.lead_min AS INTEGER) AS lead_min, coalesce(CASE WHEN thr > 0 AND thr < 100 THEN thr END, 55) AS threshold, thr IS NOT NULL AS fitted FROM a LEFT JOIN pk USING (lead_min)"""
)
def threshold_document(spark: SparkSession, base: str) -> DataFrame:
    """The picks as one JSON document (a map by lead, with a fallback), read back and asked for several leads; a lead that is not there or not valid has the fallback."""
    c = cells(spark, base).where("f1 is not null")
    best = c.groupBy("lead_min").agg(F.max(F.struct("f1", "thr", "pod", "far")).alias("m"))
    pick = F.struct(F.col("m.thr").alias("threshold_pct"), F.col("m.f1").alias("f1"), F.col("m.pod").alias("recall"), F.col("m.far").alias("far"))
    doc = best.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(55).alias("fallback_threshold_pct"), F.map_from_entries(F.collect_list(F.struct(F.col("lead_min").cast("string"), pick))).alias("leads"))).alias("doc"))  # a row a lead
    back = doc.select(F.from_json("doc", "schema_version int, fallback_threshold_pct int, leads map<string, struct<threshold_pct: int, f1: double, recall: double, far: double>>").alias("d"))
    asked = back.withColumn("lead_min", F.explode(F.array(*[F.lit(x) for x in (5, 10, 20, 30, 45, 60, 90)])))
    thr = F.col("d.leads")[F.col("lead_min").cast("string")]["threshold_pct"]
    fallback = F.when(F.col("d.fallback_threshold_pct").between(1, 99), F.col("d.fallback_threshold_pct")).otherwise(50)
    return asked.select("lead_min", F.coalesce(F.when(thr.between(1, 99), thr), fallback).alias("threshold"), thr.isNotNull().alias("fitted"))


@query(
    f"""WITH e AS (SELECT event_time, bool_or(outcome = 1) AS wet FROM calibration_corpus GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY wet ORDER BY md5('17|' || event_time), event_time) AS r, count(*) OVER (PARTITION BY wet) AS n FROM e)
SELECT event_time, wet, round(n / least(n, CASE WHEN wet THEN 60 ELSE 20 END)::DOUBLE, 6) AS weight FROM k WHERE r <= CASE WHEN wet THEN 60 ELSE 20 END"""
)
def sampled_events(spark: SparkSession, base: str) -> DataFrame:
    """Sixty wet and twenty other events by a fixed hash, with inverse-inclusion weights (a sampling operator)."""
    e = corpus(spark, base).groupBy("event_time").agg(F.max(F.col("outcome") == 1).alias("wet"))
    want = F.when(F.col("wet"), 60).otherwise(20)
    cell = W.partitionBy("wet")
    k = e.withColumns({"r": F.row_number().over(cell.orderBy(F.md5(F.concat_ws("|", F.lit("17"), "event_time")), "event_time")), "n": F.count(F.lit(1)).over(cell)}).where(F.col("r") <= want)
    return k.select("event_time", "wet", F.round(F.col("n") / F.least(F.col("n"), want), 6).alias("weight"))
