"""Scalars of radar and forecast rows, positions on the grid, ensembles at points, motion and fields put together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import geo, rain
from slotweave.operators import ensemble as E
from slotweave.operators import verification as V
from slotweave.plans.gauges import _ST, present
from slotweave.plans.grids import _C, cells
from slotweave.plans.problems import corpus_points
from slotweave.plans.problems_sql import _POINTS
from slotweave.plans.reports import corpus, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_K = 6371000.0 * (1 + math.sin(math.radians(56.0)))
_RAD = "least(" + ", ".join(f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lon - {o}) / 2), 2))))" for a, o in geo.RADARS) + ")"
_BOX = "CASE WHEN lat IS NULL OR lon IS NULL THEN NULL " + " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in geo.REGION_BOXES) + " ELSE 'Other' END"
_BAND = "CASE WHEN km < 60 THEN '0-60km' WHEN km < 90 THEN '60-90km' WHEN km < 120 THEN '90-120km' ELSE '>120km' END"


@query(
    """WITH c AS (SELECT event_time, point_id, lead_min, CAST(raw_prob AS DOUBLE) AS p, CAST(frame_age_min AS DOUBLE) AS age, outcome, epoch(CAST(event_time AS TIMESTAMPTZ)) AS t FROM calibration_corpus WHERE isfinite(raw_prob) AND isfinite(frame_age_min)),
d AS (SELECT *, p * 40 - 15.5 AS db, CAST(floor(p * 255) AS INTEGER) AS level, greatest(1, least(CAST(ceil((lead_min + greatest(age, 0)) / 5.0 - 1e-9) AS INTEGER), 18)) AS steps, p >= 0.5 AS fw,
 CASE WHEN outcome IS NULL THEN NULL ELSE outcome = 1 END AS gw FROM c)
SELECT event_time, point_id, lead_min, steps, steps * 5 AS lead_from_frame, CAST(floor(t / 60) AS BIGINT) AS ensemble_seed, round(CASE WHEN db > -14.999 THEN pow(10, db / 10) ELSE 0 END, 6) AS rain, round(CASE WHEN level < 255 THEN level * 0.1::DOUBLE + 0.5 END, 6) AS dequantised,
 round(CAST('0x' || substr(sha256('7|' || event_time), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * 10 + 2, 9) AS drawn_age, CASE WHEN p * 6 < 0.5 THEN 'trace' WHEN p * 6 < 1 THEN 'light' WHEN p * 6 < 4 THEN 'moderate' ELSE 'heavy' END AS band,
 round(p * 60 / 20, 6) AS two_slot_rate, CASE WHEN gw AND fw THEN 'both_wet' WHEN fw AND NOT gw THEN 'radar_wet_gauge_dry' WHEN gw AND NOT fw THEN 'gauge_wet_radar_dry' WHEN NOT gw AND NOT fw THEN 'both_dry' END AS dual,
 round(least(1.0, abs(p * 10 - age) / greatest(p * 10, age, 5.0)), 6) AS volatility,
 round(greatest(0.1, 1 - lead_min / 90.0) * greatest(0.0, 1 - age * 60 / 1800.0) * greatest(0.0, 1 - least(1.0, abs(p * 10 - age) / greatest(p * 10, age, 5.0))) * greatest(0.0, 1 - p / 10 * 5) * 0.5, 6) AS confidence, outcome AS outcome FROM d"""
)
def forecast_scalars(spark: SparkSession, base: str) -> DataFrame:
    """The scalar library of forecast rows over the corpus."""
    c = corpus(spark, base).where(V.finite(F.col("raw_prob")) & V.finite(F.col("frame_age_min")))
    p, age, lead = F.col("raw_prob").cast("double"), F.col("frame_age_min").cast("double"), F.col("lead_min")
    steps = E.steps_in_lead(lead, age, 5.0, 18)
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("7"), "event_time"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    vol = rain.volatility(age, p * 10)
    return c.select(
        "event_time", "point_id", "lead_min", steps.alias("steps"), (steps * 5).alias("lead_from_frame"), F.floor(F.unix_timestamp(F.to_timestamp("event_time")) / 60).alias("ensemble_seed"), F.round(rain.from_decibel(p * 40 - 15.5), 6).alias("rain"),
        F.round(rain.dequantise(F.floor(p * 255).cast("int"), 0.1, 0.5), 6).alias("dequantised"), F.round(draw * 10 + 2, 9).alias("drawn_age"), rain.intensity_band(p * 6).alias("band"), F.round(rain.two_slot_rate(p), 6).alias("two_slot_rate"),
        rain.dual_truth(F.col("outcome") == 1, p >= 0.5).alias("dual"), F.round(vol, 6).alias("volatility"), F.round(rain.confidence(lead, age * 60, vol, p / 10, F.lit(3)), 6).alias("confidence"), "outcome",
    )


@query(
    f"""WITH {_POINTS}, q AS (SELECT *, {_RAD} AS km, {_K} * tan(pi() / 4 - radians(lat) / 2) AS rho, radians(lon - 10) AS lam FROM pt),
z AS (SELECT *, rho * sin(lam) AS x, -rho * cos(lam) AS y FROM q)
SELECT point_id, round(km, 6) AS radar_km, {_BAND} AS band, {_BOX} AS box, round(x, 3) AS x, round(y, 3) AS y, round(lat, 9) AS lat, round(lon, 9) AS lon,
 round(CASE WHEN lat = 55 AND lon = 10 THEN 0 ELSE (degrees(atan2(-(lon - 10), lat - 55)) + 360) % 360 END, 6) AS bearing, round((lon - 10) * 111.320 * cos(radians(55.0)), 6) AS east_km, round((lat - 55) * 110.574, 6) AS north_km FROM z"""
)
def point_geometry(spark: SparkSession, base: str) -> DataFrame:
    """Radar distance and band, region box, plane coordinates (there and back), bearing and local offsets of every corpus point."""
    p = corpus_points(spark, base).where("point_id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").distinct()
    lat, lon = F.col("lat"), F.col("lon")
    x, y = geo.stereographic(lat, lon)
    km = geo.nearest_radar_km(lat, lon)
    back = geo.from_stereographic(x, y)
    east, north = geo.local_km(lat, lon, F.lit(55.0), F.lit(10.0))
    return p.select(
        "point_id", F.round(km, 6).alias("radar_km"), geo.radar_band(km).alias("band"), geo.region_box(lat, lon).alias("box"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(back[0], 9).alias("lat"), F.round(back[1], 9).alias("lon"),
        F.round(rain.bearing_from(lat - 55, lon - 10), 6).alias("bearing"), F.round(east, 6).alias("east_km"), F.round(north, 6).alias("north_km"),
    )


#: The grid's upper left corner in the plane and its cell size: cells of 20 km from 58 N, 5 E.
_X0, _Y0, CELL = -300_000.0, -3_150_000.0, 20_000.0


def grid_at(lat, lon):
    """(row, col) of positions; the grid is 50 cells wide."""
    x, y = geo.stereographic(lat, lon)
    return F.floor((F.lit(_Y0) - y) / CELL).cast("int"), F.floor((x - F.lit(_X0)) / CELL).cast("int")


@query(
    f"""WITH {_ST}, {_C}, q AS (SELECT *, {_K} * tan(pi() / 4 - radians(lat) / 2) AS rho, radians(lon - 10) AS lam FROM st),
z AS (SELECT station_id, CAST(floor(({_Y0} + rho * cos(lam)) / {CELL}) AS INTEGER) AS row, CAST(floor((rho * sin(lam) - {_X0}) / {CELL}) AS INTEGER) AS col FROM q)
SELECT z.station_id, z.row, z.col, round(g.v, 6) AS v, round(g.u, 6) AS u FROM z LEFT JOIN g ON z.row = g.row AND z.col = g.col"""
)
def station_samples(spark: SparkSession, base: str) -> DataFrame:
    """The grid's values at every station's pixel; null off the grid."""
    row, col = grid_at(F.col("lat"), F.col("lon"))
    st = present(spark, base).select("station_id", row.alias("row"), col.alias("col"))
    return r6(st.join(cells(spark, base).select("row", "col", "v", "u"), ["row", "col"], "left").select("station_id", "row", "col", "v", "u"), "v", "u")


@query(
    f"""WITH {_C}, z AS (SELECT vec_id, {_X0} + (col + 0.5) * {CELL} AS x, {_Y0} - (row + 0.5) * {CELL} AS y FROM g),
q AS (SELECT vec_id, degrees(pi() / 2 - 2 * atan(sqrt(x * x + y * y) / {_K})) AS lat, 10 + degrees(atan2(x, -y)) AS lon FROM z), k AS (SELECT vec_id, {_RAD} AS km FROM q)
SELECT vec_id, round(km, 6) AS km, {_BAND} AS band FROM k"""
)
def radar_distance_grid(spark: SparkSession, base: str) -> DataFrame:
    """Distance of every pixel to the nearest radar."""
    g = cells(spark, base)
    lat, lon = geo.from_stereographic(F.lit(_X0) + (F.col("col") + 0.5) * CELL, F.lit(_Y0) - (F.col("row") + 0.5) * CELL)
    km = geo.nearest_radar_km(lat, lon)
    return g.select("vec_id", F.round(km, 6).alias("km"), geo.radar_band(km).alias("band"))


@query(
    f"""WITH {_C}, x AS (SELECT vec_id, m, k, r[CAST(m * 8 + k AS BIGINT)] AS q FROM c, range(8) a(m), range(1, 9) b(k)),
m2 AS (SELECT vec_id, m, max(q) FILTER (k <= 2) AS a, max(q) FILTER (k <= 6) AS b, min(k) FILTER (q >= 0.5) AS arr FROM x GROUP BY 1, 2)
SELECT vec_id, round(avg(a), 6) AS mean_10, round(avg(b), 6) AS mean_30, round(quantile_cont(a, 0.9), 6) AS p90_10, round(quantile_cont(b, 0.9), 6) AS p90_30, count(arr) AS n_arrive,
 round(CASE WHEN count(arr) >= 4 THEN (quantile_cont(arr, 0.75) - quantile_cont(arr, 0.25)) * 5 END, 6) AS eta_spread FROM m2 GROUP BY 1"""
)
def ensemble_features(spark: SparkSession, base: str) -> DataFrame:
    """Per pixel: mean and 90th percentile over members of the greatest rate by a lead, spread of arrivals if half the members arrive; arrays in place, no explosion."""
    c = E.ensemble_features(cells(spark, base), members="members", leads={10: 2, 30: 6}, threshold=0.5, step_min=5, least=4)
    return r6(c.select("vec_id", "mean_10", "mean_30", "p90_10", "p90_30", "n_arrive", "eta_spread"), "mean_10", "mean_30", "p90_10", "p90_30", "eta_spread")


@query(
    f"""WITH {_C}, f AS (SELECT vec_id AS id, row, col FROM c), nb AS (SELECT f.id, c.r FROM (SELECT *, unnest(range(row - 2, row + 3)) AS nr FROM f) f JOIN c ON c.row = f.nr AND (c.row - f.row) * (c.row - f.row) + (c.col - f.col) * (c.col - f.col) <= 4),
x AS (SELECT id, m, k, max(r[CAST(m * 8 + k AS BIGINT)]) AS q FROM nb, range(8) a(m), range(1, 9) b(k) GROUP BY 1, 2, 3), a AS (SELECT id, m, min(k) FILTER (q >= 2.0) AS k FROM x GROUP BY 1, 2)
SELECT id, count(*) FILTER (k <= 2) / 8.0::DOUBLE AS p_10, count(*) FILTER (k <= 6) / 8.0::DOUBLE AS p_30, count(k) AS n_cross, round(quantile_cont(k, 0.25) * 5, 6) AS eta_p25, round(quantile_cont(k, 0.5) * 5, 6) AS eta_p50, round(quantile_cont(k, 0.75) * 5, 6) AS eta_p75 FROM a GROUP BY 1"""
)
def at_home(spark: SparkSession, base: str) -> DataFrame:
    """Every pixel as a home: the disc's greatest rate per member and step, probability within a lead, quartiles of arrival over the members that cross."""
    g = cells(spark, base)
    h = E.disc_members(g, g.select(F.col("vec_id").alias("id"), "row", "col"), radius=2, members="members", n_members=8, n_steps=8)
    first = F.filter(F.transform("members", lambda m: F.coalesce(F.array_position(F.transform(m, lambda x: x >= 2.0), True), F.lit(0))), lambda k: k > 0)
    h = h.withColumn("arr", F.array_sort(F.transform(first, lambda k: k.cast("double"))))
    q = lambda p: F.round(E.array_quantile(F.col("arr"), p) * 5, 6)
    by = lambda k: F.size(F.filter("arr", lambda a: a <= k)) / 8.0
    return h.select("id", by(2).alias("p_10"), by(6).alias("p_30"), F.size("arr").cast("long").alias("n_cross"), q(0.25).alias("eta_p25"), q(0.5).alias("eta_p50"), q(0.75).alias("eta_p75"))


@query(
    f"""WITH {_C}, s AS (SELECT label, u, v, u * v AS e FROM g WHERE v >= 0.2), t AS (SELECT label, quantile_cont(e, 0.5) AS cut, sum(u * v) / sum(v) AS mean FROM s GROUP BY 1),
k AS (SELECT label, count(*) AS n, quantile_cont(u, 0.5) AS med FROM s JOIN t USING (label) WHERE e >= cut AND e > 0 GROUP BY 1)
SELECT label, coalesce(n, 0) AS n, round(CASE WHEN n >= 8 THEN med ELSE mean END, 6) AS bulk, coalesce(n >= 8, false) AS robust FROM t LEFT JOIN k USING (label)"""
)
def robust_motion(spark: SparkSession, base: str) -> DataFrame:
    """Median motion of the most textured wet pixels; the rain-weighted mean where they are too few."""
    s = cells(spark, base).where("v >= 0.2").withColumn("e", F.col("u") * F.col("v"))
    cutoff = V.quantiles(s, ["label"], "e", (0.5,), 0.25).select("label", F.col("q0").alias("cut"))
    mean = s.groupBy("label").agg((F.sum("e") / F.sum("v")).alias("mean"))
    t = mean.join(cutoff, "label")
    k = V.quantiles(s.join(cutoff, "label").where("e >= cut and e > 0"), ["label"], "u", (0.5,), 0.25)
    enough = F.coalesce(F.col("n") >= 8, F.lit(False))
    return t.join(k, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.when(enough, F.col("q0")).otherwise(F.col("mean")), 6).alias("bulk"), enough.alias("robust"))


@query(
    f"""WITH {_C}, a AS (SELECT vec_id, row, col, CASE WHEN v >= 0.6 THEN v END AS fresh, CASE WHEN u >= 0.3 THEN u END AS older, r[3] AS third FROM (SELECT g.*, c.r FROM g JOIN c USING (vec_id)))
SELECT vec_id, round(coalesce(fresh, older, 0), 6) AS field, CASE WHEN fresh IS NOT NULL THEN 'fresh' WHEN older IS NOT NULL THEN 'older' ELSE 'none' END AS source,
 CASE WHEN fresh IS NOT NULL AND older IS NOT NULL THEN round(fresh + older + third - greatest(fresh, older, third) - least(fresh, older, third), 6) END AS median3 FROM a"""
)
def combined_field(spark: SparkSession, base: str) -> DataFrame:
    """Per pixel the freshest frame that covers it, an older one where none does, and the median of three where all are there."""
    g = cells(spark, base)
    fresh, older, third = F.when(F.col("v") >= 0.6, F.col("v")), F.when(F.col("u") >= 0.3, F.col("u")), F.get(F.get("members", F.lit(0)), F.lit(2))
    med = fresh + older + third - F.greatest(fresh, older, third) - F.least(fresh, older, third)
    return g.select("vec_id", F.round(F.coalesce(fresh, older, F.lit(0.0)), 6).alias("field"), F.when(fresh.isNotNull(), "fresh").when(older.isNotNull(), "older").otherwise("none").alias("source"), F.round(F.when(fresh.isNotNull() & older.isNotNull(), med), 6).alias("median3"))
