"""Queries over gauge readings and warnings: slots, onsets, runs, joins in time, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.text import station_number
from slotweave.functions.timeexpr import MICROS, micros, slot_end_us
from slotweave.operators import gauge as G
from slotweave.operators import verification as V
from slotweave.operators.blocks import block_of, carried
from slotweave.operators.spatial import near_pairs
from slotweave.plans.reports import r6
from slotweave.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def slots(spark: SparkSession, base: str) -> DataFrame:
    return G.slot_amounts(table(spark, base, "observations"))


def warnings(spark: SparkSession, base: str) -> DataFrame:
    w = table(spark, base, "warnings_scored").where("station_id is not null and warned_at_utc is not null")
    return w.withColumn("station_id", station_number(F.col("station_id"))).withColumn("t_us", micros("warned_at_utc"))


_US = "epoch_us"
_SLOTS = """o AS (SELECT station_id, parameter_id, epoch_us(observed_utc) + ((-epoch_us(observed_utc)) % 600000000 + 600000000) % 600000000 AS slot_us,
   CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN greatest(CAST(value AS DOUBLE), 0) END AS v FROM observations WHERE parameter_id IN ('precip_past10min', 'precip_dur_past10min')),
f AS (SELECT station_id, slot_us, max(v) FILTER (parameter_id = 'precip_past10min') AS mm, max(v) FILTER (parameter_id = 'precip_dur_past10min') AS dur FROM o GROUP BY 1, 2 HAVING count(v) > 0),
sp AS (SELECT station_id, min(slot_us) AS a, max(slot_us) AS b FROM f GROUP BY 1),
g AS (SELECT station_id, unnest(range(a, b + 1, 600000000)) AS slot_us FROM sp),
s AS (SELECT g.station_id, g.slot_us, mm, dur, CASE WHEN mm IS NOT NULL OR dur IS NOT NULL THEN coalesce(mm >= 0.1, false) OR coalesce(dur >= 1.0, false) END AS wet FROM g LEFT JOIN f USING (station_id, slot_us))"""
_PAD = lambda c: f"CASE WHEN length(trim({c})) < 5 THEN lpad(trim({c}), 5, '0') ELSE trim({c}) END"
_WARN = f"w AS (SELECT *, {_PAD('station_id')} AS sid, epoch_us(warned_at_utc) AS t_us FROM warnings_scored WHERE station_id IS NOT NULL AND warned_at_utc IS NOT NULL)"
_ISO = lambda c: f"strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%SZ')"
_ONSETS = """q AS (SELECT *, sum(CASE WHEN NOT wet THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY slot_us ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS dry,
  coalesce(mm, 0) + coalesce(lead(mm) OVER (PARTITION BY station_id ORDER BY slot_us), 0) AS depth FROM s),
n AS (SELECT station_id, slot_us AS onset_us, depth FROM q WHERE dry = 6 AND wet AND depth >= 0.2 - 1e-9)"""


@query(f"WITH {_SLOTS} SELECT station_id, slot_us, round(mm, 6) + 0.0 AS mm, round(dur, 6) + 0.0 AS dur, wet FROM s")
def gauge_slots(spark: SparkSession, base: str) -> DataFrame:
    return r6(slots(spark, base), "mm", "dur")


@query(f"WITH {_SLOTS}, {_ONSETS} SELECT station_id, onset_us, round(depth, 6) AS depth FROM n")
def rain_onsets(spark: SparkSession, base: str) -> DataFrame:
    return r6(G.onsets(slots(spark, base)), "depth")


@query(
    f"WITH {_SLOTS}, {_ONSETS.replace('6 PRECEDING', '3 PRECEDING').replace('dry = 6', 'dry = 3').replace('0.2 - 1e-9', '1.0 - 1e-9')} SELECT station_id, count(*) AS n_onsets, round(max(depth), 6) AS deepest FROM n GROUP BY 1"
)
def onset_sensitivity(spark: SparkSession, base: str) -> DataFrame:
    """Onsets under another definition: 30 dry minutes, 1 mm."""
    o = G.onsets(slots(spark, base), dry_min=30, least_mm=1.0)
    return r6(o.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_onsets"), F.max("depth").alias("deepest")), "deepest")


@query(
    f"""WITH {_SLOTS}, k AS (SELECT station_id, count(wet) AS n_known, count(*) FILTER (wet) AS n_wet FROM s GROUP BY 1)
SELECT station_id, n_known, n_wet, n_wet = 0 AND n_known >= 100 AND (SELECT max(n_wet) FROM k) > 0 AS dead FROM k"""
)
def dead_gauges(spark: SparkSession, base: str) -> DataFrame:
    """Stations that were known and never wet; void if no station was wet."""
    k = slots(spark, base).groupBy("station_id").agg(F.count("wet").alias("n_known"), F.count_if(F.coalesce("wet", F.lit(False))).alias("n_wet"))
    any_wet = F.max("n_wet").over(W.partitionBy(F.lit(1)))  # one row a station
    return k.withColumn("dead", (F.col("n_wet") == 0) & (F.col("n_known") >= 100) & (any_wet > 0))


@query(
    f"""WITH {_WARN}, d AS (SELECT sid AS station_id, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY sid ORDER BY t_us) > 7200000000 THEN 1 ELSE 0 END AS nw FROM w),
r AS (SELECT *, sum(nw) OVER (PARTITION BY station_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d)
SELECT station_id, CAST(run AS BIGINT) AS run, min(t_us) AS from_us, max(t_us) AS to_us, count(*) AS n FROM r GROUP BY 1, 2"""
)
def warning_runs(spark: SparkSession, base: str) -> DataFrame:
    """Sessions of warnings at most two hours apart."""
    return G.coverage_runs(warnings(spark, base), "station_id", F.col("t_us"), gap_min=120)


@query(
    f"""WITH {_WARN}, {_SLOTS},
p AS (SELECT warning_id, sid, unnest(range((t_us + 1) + ((-(t_us + 1)) % 600000000 + 600000000) % 600000000, t_us + 1800000001, 600000000)) AS slot_us FROM w),
j AS (SELECT p.warning_id, s.wet, s.mm FROM p LEFT JOIN s ON p.sid = s.station_id AND p.slot_us = s.slot_us)
SELECT warning_id, bool_or(wet) AS any_wet, count(wet) AS n_known, count(*) AS n_slots, round(sum(mm), 6) AS mm, CASE WHEN bool_or(wet) THEN 1 WHEN count(wet) = count(*) THEN 0 END AS outcome, 3 AS expected FROM j GROUP BY 1"""
)
def window_outcome(spark: SparkSession, base: str) -> DataFrame:
    """Did it rain within half an hour of each warning?"""
    return r6(G.window_outcome(warnings(spark, base), slots(spark, base), station="station_id", at_us="t_us", minutes=30, row_id=["warning_id"]), "mm")


@query(
    f"""WITH {_WARN}, {_SLOTS}, {_ONSETS}
SELECT warning_id, min(onset_us) AS found_us, round(arg_min(depth, onset_us), 6) AS found FROM w LEFT JOIN n ON w.sid = n.station_id AND onset_us > t_us AND onset_us <= t_us + 2400000000 GROUP BY 1"""
)
def next_onset(spark: SparkSession, base: str) -> DataFrame:
    """Forward as-of: the first onset within lead and tolerance after each warning."""
    o = G.onsets(slots(spark, base))
    return r6(G.as_of(warnings(spark, base), o, key="station_id", left_us="t_us", right_us="onset_us", value="depth", row_id=["warning_id"], within_min=40, forward=True, strict=True), "found")


@query(
    f"""WITH {_WARN}, {_SLOTS}, k AS (SELECT * FROM s WHERE wet)
SELECT warning_id, max(slot_us) AS found_us, round(arg_max({{'m': mm}}, slot_us).m, 6) AS found FROM w LEFT JOIN k ON w.sid = k.station_id AND slot_us <= t_us AND slot_us >= t_us - 3600000000 GROUP BY 1"""
)
def last_wet_slot(spark: SparkSession, base: str) -> DataFrame:
    """Backward as-of: the last wet slot up to an hour before each warning."""
    wet = slots(spark, base).where("wet")
    return r6(G.as_of(warnings(spark, base), wet, key="station_id", left_us="t_us", right_us="slot_us", value="mm", row_id=["warning_id"], within_min=60), "found")


@query(
    f"""WITH {_WARN}, {_SLOTS}
SELECT sid AS station_id, count(*) FILTER (p_rain >= 0.5 AND wet) AS hits, count(*) FILTER (NOT p_rain >= 0.5 AND wet) AS misses, count(*) FILTER (p_rain >= 0.5 AND NOT wet) AS false_alarms, count(*) FILTER (NOT p_rain >= 0.5 AND NOT wet) AS correct
FROM w JOIN s ON w.sid = s.station_id AND s.slot_us = t_us + ((-t_us) % 600000000 + 600000000) % 600000000 GROUP BY 1"""
)
def raining_now_agreement(spark: SparkSession, base: str) -> DataFrame:
    """Forecast against the slot that holds the instant: a table per station."""
    w = warnings(spark, base).withColumn("slot_us", slot_end_us(F.col("t_us")))
    return w.join(slots(spark, base), ["station_id", "slot_us"]).groupBy("station_id").agg(*V.contingency(F.col("p_rain") >= 0.5, F.col("wet")))


_TRAIL = """x AS (SELECT station_id, slot_us,
 sum(mm) OVER h10 AS g_mm_10, sum(mm) OVER h30 AS g_mm_30, sum(mm) OVER h60 AS g_mm_60, count(wet) OVER h30 AS n30, coalesce(bool_or(wet) OVER h30, false) AS w30, count(wet) OVER h60 AS n60, bool_or(wet) OVER h60 AS w60,
 max(CASE WHEN wet THEN slot_us END) OVER h360 AS lw, max(CASE WHEN wet IS NOT NULL THEN slot_us END) OVER h360 AS lk FROM s
 WINDOW h10 AS (PARTITION BY station_id ORDER BY slot_us RANGE BETWEEN 0 PRECEDING AND CURRENT ROW), h30 AS (PARTITION BY station_id ORDER BY slot_us RANGE BETWEEN 1200000000 PRECEDING AND CURRENT ROW),
  h60 AS (PARTITION BY station_id ORDER BY slot_us RANGE BETWEEN 3000000000 PRECEDING AND CURRENT ROW), h360 AS (PARTITION BY station_id ORDER BY slot_us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW))"""


@query(
    f"""WITH {_SLOTS}, {_TRAIL}
SELECT station_id, slot_us, round(g_mm_10, 6) AS g_mm_10, round(g_mm_30, 6) AS g_mm_30, round(g_mm_60, 6) AS g_mm_60, n30 AS g_known_30, w30 AS g_wet_30,
 CASE WHEN w60 THEN 0 WHEN n60 > 0 THEN 1 END AS g_dry_60, CAST((slot_us - lw) // 60000000 AS BIGINT) AS g_min_since_wet FROM x"""
)
def gauge_features(spark: SparkSession, base: str) -> DataFrame:
    """Trailing features of each slot: depths over 10, 30 and 60 minutes, dryness of the hour, minutes since rain within six hours."""
    t = G.trailing_features(slots(spark, base))
    since = F.floor((F.col("slot_us") - F.col("last_wet_us")) / F.lit(60 * MICROS))
    return t.select("station_id", "slot_us", *[F.round(f"g_mm_{m}", 6).alias(f"g_mm_{m}") for m in (10, 30, 60)], "g_known_30", "g_wet_30", "g_dry_60", since.alias("g_min_since_wet"))


@query(
    f"""WITH {_WARN}, {_SLOTS}, v AS (SELECT warning_id, t_us, (t_us - 600000000) // 600000000 * 600000000 AS h, k.slot_us, k.mm, k.wet FROM w LEFT JOIN s k ON w.sid = k.station_id AND k.slot_us <= t_us - 600000000 AND k.slot_us >= t_us - 21600000000),
a AS (SELECT warning_id, sum(mm) FILTER (slot_us > h - 600000000) AS m10, sum(mm) FILTER (slot_us > h - 1800000000) AS m30, sum(mm) FILTER (slot_us > h - 3600000000) AS m60, count(wet) AS known,
 min(t_us - slot_us) FILTER (wet) AS since, bool_or(wet) FILTER (slot_us > h - 3600000000) AS w60, count(wet) FILTER (slot_us > h - 3600000000) AS n60 FROM v GROUP BY 1)
SELECT warning_id, round(CASE WHEN known > 0 THEN m10 END, 6) AS g_mm_10, round(CASE WHEN known > 0 THEN m30 END, 6) AS g_mm_30, round(CASE WHEN known > 0 THEN m60 END, 6) AS g_mm_60,
 CASE WHEN known > 0 THEN CAST(coalesce(since // 60000000, 360) AS BIGINT) END AS g_min_since_wet, CASE WHEN w60 THEN 0 WHEN n60 > 0 THEN 1 END AS g_dry_60, CASE WHEN n60 > 0 THEN 1 ELSE 0 END AS g_known FROM a"""
)
def decision_gauge_features(spark: SparkSession, base: str) -> DataFrame:
    """The station's own gauge as seen at each warning, ten minutes behind."""
    s = G.slot_amounts(table(spark, base, "observations"), after_min=370)
    return r6(G.features_at(warnings(spark, base), s, station="station_id", at_us="t_us", row_id=["warning_id"]), "g_mm_10", "g_mm_30", "g_mm_60")


@query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY (operation_to IS NULL) DESC, operation_from DESC) AS k FROM station_catalogue WHERE station_id IS NOT NULL)
SELECT station_id, name, lat, lon, country, status, operation_to IS NULL AS present FROM c WHERE k = 1"""
)
def current_stations(spark: SparkSession, base: str) -> DataFrame:
    """One row per station: the open one first, then the latest."""
    w = W.partitionBy("station_id").orderBy(F.col("operation_to").isNull().desc(), F.col("operation_from").desc())
    c = table(spark, base, "station_catalogue").where("station_id is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    return c.select("station_id", "name", "lat", "lon", "country", "status", F.col("operation_to").isNull().alias("present"))


_HAV = lambda a, b: f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_ST = "st AS (SELECT station_id, lat, lon FROM station_catalogue WHERE operation_to IS NULL AND station_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL)"


def present(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "station_catalogue").where("operation_to is null and station_id is not null and lat is not null and lon is not null").select("station_id", "lat", "lon")


@query(
    f"""WITH {_ST} SELECT a.station_id AS a, b.station_id AS b, round({_HAV("a", "b")}, 6) AS km,
 round(((degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360), 4) AS bearing
FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {_HAV("a", "b")} <= 60"""
)
def neighbour_stations(spark: SparkSession, base: str) -> DataFrame:
    """Stations within 60 km of each other with distance and bearing."""
    p = near_pairs(present(spark, base), "station_id", 60.0)
    return p.select("a", "b", F.round("km", 6).alias("km"), F.round("bearing", 4).alias("bearing"))


@query(
    f"""WITH RECURSIVE {_ST}, e AS (SELECT a.station_id AS a, b.station_id AS b FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {_HAV("a", "b")} <= 30),
r AS (SELECT station_id AS n, station_id AS m FROM st UNION SELECT e.b, r.m FROM r JOIN e ON r.n = e.a)
SELECT n AS station_id, min(m) AS component FROM r GROUP BY 1"""
)
def station_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Connected components of stations within 30 km (least label, spreading until nothing changes)."""
    from slotweave.operators.components import connected_components

    st = present(spark, base)
    edges = near_pairs(st, "station_id", 30.0).select("a", "b")
    return connected_components(st.select(F.col("station_id").alias("id")), edges).select(F.col("id").alias("station_id"), "component")


@query(
    f"""WITH {_SLOTS}, {_ST},
e AS (SELECT a.station_id AS a, b.station_id AS b, {_HAV("a", "b")} AS km FROM st a JOIN st b ON a.station_id <> b.station_id WHERE {_HAV("a", "b")} <= 60)
SELECT a AS station_id, slot_us, round(max(mm), 6) AS mm_max, round(sum(mm / greatest(km, 1)) / sum(CASE WHEN mm IS NOT NULL THEN 1 / greatest(km, 1) END), 6) AS mm_wmean,
 round(avg(CASE WHEN wet THEN 1.0 WHEN NOT wet THEN 0.0 END), 6) AS wet_share, count(wet) AS n, round(min(km), 6) AS near_km FROM e JOIN s h ON e.b = h.station_id GROUP BY 1, 2"""
)
def neighbour_gauge_features(spark: SparkSession, base: str) -> DataFrame:
    """For every station and slot: the greatest and weighted depth, wet share and number of gauges within 60 km."""
    h = slots(spark, base)
    e = near_pairs(present(spark, base), "station_id", 60.0).select(F.col("a").alias("station_id"), F.col("b").alias("other"), "km")
    j = e.join(h.withColumnRenamed("station_id", "other"), "other")
    wt = 1 / F.greatest(F.col("km"), F.lit(1.0))
    return r6(j.groupBy("station_id", "slot_us").agg(
        F.max("mm").alias("mm_max"), V.ratio(F.sum(F.col("mm") * wt), F.sum(F.when(F.col("mm").isNotNull(), wt))).alias("mm_wmean"), F.avg(F.col("wet").cast("int")).alias("wet_share"), F.count("wet").alias("n"), F.min("km").alias("near_km")
    ), "mm_max", "mm_wmean", "wet_share", "near_km")


@query(
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc, parameter_id ORDER BY coalesce(created_utc, observed_utc) DESC, obs_id DESC) AS r FROM observations)
SELECT station_id, parameter_id, count(*) AS n, count(value) AS n_known, min(epoch_us(observed_utc)) AS first_us, max(epoch_us(observed_utc)) AS last_us, round(sum(CAST(value AS DOUBLE)), 3) AS total FROM k WHERE r = 1 GROUP BY 1, 2"""
)
def deduplicated_counts(spark: SparkSession, base: str) -> DataFrame:
    """Last writer wins on the natural key, then counts per station and parameter."""
    from slotweave.sources.store import dedupe_last

    o = dedupe_last(table(spark, base, "observations"), ["station_id", "observed_utc", "parameter_id"], [F.coalesce("created_utc", "observed_utc"), F.col("obs_id")])
    return o.groupBy("station_id", "parameter_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.min(micros("observed_utc")).alias("first_us"), F.max(micros("observed_utc")).alias("last_us"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query(
    """WITH k AS (SELECT station_id, parameter_id, count(*) AS n, count(DISTINCT epoch_us(observed_utc) // 600000000) AS n_slots, date_diff('day', min(date_trunc('day', observed_utc)), max(date_trunc('day', observed_utc))) + 1 AS days FROM observations GROUP BY 1, 2)
SELECT station_id, parameter_id, n, n_slots, days, round(n_slots / (days * 144.0), 6) AS coverage FROM k WHERE n_slots / (days * 144.0) >= 0.5"""
)
def station_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Stations and parameters that fill at least half their slots."""
    us = micros("observed_utc")
    day = F.floor(us / F.lit(86400 * MICROS))
    k = table(spark, base, "observations").groupBy("station_id", "parameter_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.floor(us / F.lit(600 * MICROS))).alias("n_slots"), (F.max(day) - F.min(day) + 1).alias("days"))
    return k.withColumn("c", F.col("n_slots") / (F.col("days") * 144.0)).where("c >= 0.5").select("station_id", "parameter_id", "n", "n_slots", "days", F.round("c", 6).alias("coverage"))


@query(
    """WITH p AS (SELECT station_id, epoch_us(observed_utc) AS us, round(max(value) FILTER (parameter_id = 'precip_past10min')::DOUBLE, 6) + 0.0 AS mm, round(max(value) FILTER (parameter_id = 'precip_dur_past10min')::DOUBLE, 6) + 0.0 AS dur, round(max(value) FILTER (parameter_id = 'temp_dry')::DOUBLE, 6) AS temp FROM observations GROUP BY 1, 2)
SELECT * FROM p WHERE dur IS NOT NULL OR temp IS NOT NULL"""
)
def wide_readings(spark: SparkSession, base: str) -> DataFrame:
    """Long readings to one row per station and instant."""
    o = table(spark, base, "observations").withColumn("us", micros("observed_utc")).withColumn("value", F.col("value").cast("double"))
    names = {"precip_past10min": "mm", "precip_dur_past10min": "dur", "temp_dry": "temp"}
    wide = o.groupBy("station_id", "us").pivot("parameter_id", list(names)).agg(F.round(F.max("value"), 6) + 0.0)
    return wide.withColumnsRenamed(names).where("dur is not null or temp is not null")


@query(
    """WITH h AS (SELECT station_id, epoch_us(observed_utc) AS us, CAST(value AS DOUBLE) AS v, obs_id FROM observations WHERE parameter_id = 'temp_dry' AND value IS NOT NULL),
m AS (SELECT *, CASE WHEN v >= 15 THEN 1 WHEN v < 13 THEN 0 END AS mark, row_number() OVER (PARTITION BY station_id ORDER BY us, obs_id) AS i FROM h),
g AS (SELECT *, count(mark) OVER (PARTITION BY station_id ORDER BY i) AS grp FROM m)
SELECT obs_id, coalesce(max(mark) OVER (PARTITION BY station_id, grp), 0) AS state FROM g"""
)
def hysteresis(spark: SparkSession, base: str) -> DataFrame:
    """A two-threshold switch: on from 15, off below 13, unchanged between; off at the start."""
    h = table(spark, base, "observations").where("parameter_id = 'temp_dry' and value is not null").select("station_id", micros("observed_utc").alias("us"), F.col("value").cast("double").alias("v"), "obs_id")
    h = h.withColumn("mark", F.when(F.col("v") >= 15, 1).when(F.col("v") < 13, 0)).withColumn("block", block_of(F.col("us"), G.BLOCK_US))
    last = F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("us", "obs_id")))
    h = carried(h, ["station_id"], "block", {"m": last}, {"before": ("last", F.col("m"))})  # one row a block carries the state on
    w = W.partitionBy("station_id", "block").orderBy("us", "obs_id").rowsBetween(W.unboundedPreceding, 0)
    return h.select("obs_id", F.coalesce(F.last("mark", ignorenulls=True).over(w), "before", F.lit(0)).alias("state"))
