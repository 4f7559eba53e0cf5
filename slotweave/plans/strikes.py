"""Queries of point events: the warnings at their stations, scattered by a fixed hash, are read as strikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import geo
from slotweave.functions.timeexpr import DAY_US, MICROS, instant
from slotweave.operators import lightning as L
from slotweave.operators import tracking
from slotweave.operators import verification as V
from slotweave.plans.gauges import _ST, _WARN, present, warnings
from slotweave.plans.fields import _BOX
from slotweave.plans.scoring import _DRAW
from slotweave.streaming.pipelines import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STRIDE, RINGS, LEAST = 60, (3.0, 10.0), 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def strikes(spark: SparkSession, base: str) -> DataFrame:
    w = warnings(spark, base).join(present(spark, base), "station_id")
    at = lambda c, seed, k: F.round(F.col(c) + (V.hash_draw(F.col("warning_id"), seed=seed) - 0.5) * k, 9)
    return w.select(F.col("warning_id").alias("id"), at("lat", 31, 0.4).alias("lat"), at("lon", 32, 0.7).alias("lon"), F.col("t_us").alias("us"))


_D = lambda seed: _DRAW(f"'{seed}'", "CAST(warning_id AS VARCHAR)")
_KM = lambda a, b, c, d: f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_STRIKES = f"{_WARN}, {_ST}, sk AS (SELECT warning_id AS id, round(lat + ({_D(31)} - 0.5) * 0.4, 9) AS lat, round(lon + ({_D(32)} - 0.5) * 0.7, 9) AS lon, t_us AS us FROM w JOIN st ON w.sid = st.station_id)"
_NEAR = f"""{_STRIKES}, r0 AS (SELECT st.station_id AS target, st.lat AS tlat, st.lon AS tlon, sk.*, {_KM("st.lat", "st.lon", "sk.lat", "sk.lon")} AS km, us + ((-us) % 3600000000 + 3600000000) % 3600000000 AS at_us FROM st JOIN sk ON abs(st.lat - sk.lat) < 0.6 AND {_KM("st.lat", "st.lon", "sk.lat", "sk.lon")} <= 60),
r1 AS (SELECT *, count(*) OVER (PARTITION BY target, at_us) AS n_strikes FROM r0), rel AS (SELECT *, (us - at_us) / 6e7 AS t, (lon - tlon) * 111.320 * cos(radians(tlat)) AS e, (lat - tlat) * 110.574 AS n FROM r1 WHERE n_strikes >= {LEAST}),
lk AS (SELECT a.target, a.at_us, a.id AS a, b.id AS b FROM rel a JOIN rel b ON a.target = b.target AND a.at_us = b.at_us AND a.id <> b.id AND {_KM("a.lat", "a.lon", "b.lat", "b.lon")} <= 15),
rc AS (SELECT target, at_us, id AS n, id AS m FROM rel UNION SELECT rc.target, rc.at_us, lk.b, rc.m FROM rc JOIN lk ON rc.target = lk.target AND rc.at_us = lk.at_us AND rc.n = lk.a),
ce AS (SELECT target, at_us, n AS id, min(m) AS cell FROM rc GROUP BY 1, 2, 3), me AS (SELECT rel.*, cell FROM rel JOIN ce USING (target, at_us, id)),
o1 AS (SELECT target, at_us, cell, max(n_strikes) AS n_strikes, count(*) AS size, avg(lat) AS clat, avg(lon) AS clon, avg(e) AS ce, avg(n) AS cn, max(t) AS last, max(t) - min(t) AS span,
  CASE WHEN max(t) > min(t) THEN regr_slope(e, t) END AS ve, CASE WHEN max(t) > min(t) THEN regr_slope(n, t) END AS vn, CASE WHEN max(t) > min(t) THEN regr_intercept(e, t) END AS ie, CASE WHEN max(t) > min(t) THEN regr_intercept(n, t) END AS i_n FROM me GROUP BY 1, 2, 3),
o2 AS (SELECT target, at_us, cell, avg({_KM("clat", "clon", "lat", "lon")}) AS spread_km, min(km) FILTER (last - t <= 5) AS edge_km, sqrt(avg(pow(e - ie - ve * t, 2) + pow(n - i_n - vn * t, 2))) AS resid FROM me JOIN o1 USING (target, at_us, cell) GROUP BY 1, 2, 3),
mo AS (SELECT target, at_us, cell, n_strikes, size, clat, clon, spread_km, -last AS age_min, edge_km, CASE WHEN span >= 3 AND sqrt(ce * ce + cn * cn) > 1e-6 THEN -(ve * ce + vn * cn) / sqrt(ce * ce + cn * cn) ELSE 0 END * 60 AS closing_kmh,
  CASE WHEN span >= 3 THEN sqrt(ve * ve + vn * vn) * 60 END AS speed_kmh, CASE WHEN span >= 3 THEN ve END AS ve, CASE WHEN span >= 3 THEN vn END AS vn,
  least(1.0, size::DOUBLE / 12) * 0.4::DOUBLE + least(1.0, span / 10.0) * 0.3::DOUBLE + 0.3::DOUBLE / (1 + coalesce(resid, 0) / 3.0) AS confidence FROM o1 JOIN o2 USING (target, at_us, cell))"""


def seen(spark: SparkSession, base: str, few: bool = False) -> DataFrame:
    """What every station sees at every hour."""
    targets = present(spark, base).withColumnRenamed("station_id", "target")
    return tracking.seen(strikes(spark, base), targets, stride_min=STRIDE, buffer_min=STRIDE, least=LEAST, few=few)


@query(
    f"""WITH RECURSIVE {_NEAR} SELECT target, at_us, cell, n_strikes, size, round(clat, 6) AS clat, round(clon, 6) AS clon, round(spread_km, 6) AS spread_km, round(age_min, 6) AS age_min, round(edge_km, 6) AS edge_km,
 round(closing_kmh, 4) + 0.0 AS closing_kmh, round(speed_kmh, 4) AS speed_kmh, round(confidence, 5) AS confidence FROM mo"""
)
def strike_cells(spark: SparkSession, base: str) -> DataFrame:
    """Cells of strikes around every station at every hour with their motion."""
    m = seen(spark, base).select("*", F.explode("cells").alias("c")).select("target", "at_us", "c.cell", "n_strikes", *[f"c.{k}" for k in ("size", "clat", "clon", "spread_km", "age_min", "edge_km", "closing_kmh", "speed_kmh", "confidence")])
    six = {c: F.round(c, 6) for c in ("clat", "clon", "spread_km", "age_min", "edge_km")}
    return m.withColumns(six | {"closing_kmh": F.round("closing_kmh", 4) + 0.0, "speed_kmh": F.round("speed_kmh", 4), "confidence": F.round("confidence", 5)})


_OUT = f"""{_NEAR}, s1 AS (SELECT *, CASE WHEN edge_km <= 3 THEN 'inside' WHEN closing_kmh < 0 THEN 'receding' WHEN closing_kmh < 5 THEN 'stalled' ELSE 'approaching' END AS state FROM mo),
s2 AS (SELECT *, CASE WHEN edge_km <= 3 THEN 0 WHEN state = 'approaching' THEN round((edge_km - 3) / (closing_kmh / 60), 1) END AS eta_3, CASE WHEN edge_km <= 10 THEN 0 WHEN state = 'approaching' THEN round((edge_km - 10) / (closing_kmh / 60), 1) END AS eta_10,
  CASE WHEN edge_km <= 3 THEN 0 WHEN closing_kmh < 5 THEN 'infinity'::DOUBLE ELSE (edge_km - 3) / (closing_kmh / 60) END AS threat FROM s1),
ot AS (SELECT target, at_us, max(n_strikes) AS n_strikes, count(*) AS n_cells, arg_min({{'cell': cell, 'state': state, 'edge': edge_km, 'closing': closing_kmh, 'e3': eta_3, 'e10': eta_10}}, {{'a': threat, 'b': edge_km, 'c': cell}}) AS b,
  min(CASE state WHEN 'inside' THEN 0 WHEN 'approaching' THEN 1 WHEN 'stalled' THEN 2 ELSE 3 END) AS k, min(eta_3) AS any_eta_3, min(eta_10) AS any_eta_10 FROM s2 GROUP BY 1, 2)"""


@query(
    f"""WITH RECURSIVE {_OUT} SELECT target, at_us, n_strikes, n_cells, b.cell AS cell, b.state AS state, round(b.edge, 2) AS edge_km, round(b.closing, 1) + 0.0 AS closing_kmh, b.e3 AS eta_3, b.e10 AS eta_10, ['inside', 'approaching', 'stalled', 'receding'][k + 1] AS any_state, any_eta_3, any_eta_10 FROM ot"""
)
def strike_outlook(spark: SparkSession, base: str) -> DataFrame:
    """The most threatening cell of every station and hour, and the soonest arrival over all cells."""
    o = L.outlook_of(seen(spark, base), RINGS)
    return o.withColumns({"edge_km": F.round("edge_km", 2), "closing_kmh": F.round("closing_kmh", 1) + 0.0}).drop("confidence")


@query(
    f"""WITH RECURSIVE {_OUT}, rg AS (SELECT unnest([3, 10]) AS ring), hit AS (SELECT DISTINCT target, us + ((-us) % 3600000000 + 3600000000) % 3600000000 - 3600000000 AS at_us, ring FROM r0, rg WHERE km <= ring),
fc AS (SELECT ot.target, ot.at_us, ring, coalesce(CASE ring WHEN 3 THEN any_eta_3 ELSE any_eta_10 END <= 60, false) AS fire, hit.target IS NOT NULL AS truth FROM ot CROSS JOIN rg LEFT JOIN hit USING (target, at_us, ring)),
lb AS (SELECT fc.*, {_BOX.replace('lat', 'st.lat').replace('lon', 'st.lon')} AS region FROM fc JOIN st ON st.station_id = fc.target)
SELECT region, ring, count(*) FILTER (fire AND truth) AS hits, count(*) FILTER (NOT fire AND truth) AS misses, count(*) FILTER (fire AND NOT truth) AS false_alarms, count(*) FILTER (NOT fire AND NOT truth) AS correct FROM lb GROUP BY 1, 2"""
)
def strike_backtest(spark: SparkSession, base: str) -> DataFrame:
    """Announced arrivals within the hour against strikes inside the ring in the hour, per region and ring."""
    o = L.judged(seen(spark, base, few=True), RINGS)
    # what is announced at an instant and what came true of the instant before meet in one row
    said = F.struct(F.col("at_us"), (F.size("cells") > 0).alias("said"), *[F.coalesce(F.col(f"any_eta_{r:g}") <= 60, F.lit(False)).alias(f"fire_{r:g}") for r in RINGS], *[F.lit(False).alias(f"hit_{r:g}") for r in RINGS])
    came = F.struct((F.col("at_us") - F.lit(STRIDE * 60 * MICROS)).alias("at_us"), F.lit(False).alias("said"), *[F.lit(False).alias(f"fire_{r:g}") for r in RINGS], *[(F.col("near_km") <= r).alias(f"hit_{r:g}") for r in RINGS])
    x = o.select("target", F.explode(F.array(said, came)).alias("x")).select("target", "x.*")
    flags = [c for c in x.columns if c not in ("target", "at_us")]
    x = x.where(" or ".join(["said", *[c for c in flags if c.startswith("hit")]])).groupBy("target", "at_us").agg(*[F.max(c).alias(c) for c in flags]).where("said")
    ring = F.explode(F.array(*[F.struct(F.lit(int(r)).alias("ring"), F.col(f"fire_{r:g}").alias("fire"), F.col(f"hit_{r:g}").alias("truth")) for r in RINGS]))
    f = x.select("target", ring.alias("x")).select("target", "x.*")
    st = present(spark, base).select(F.col("station_id").alias("target"), geo.region_box(F.col("lat"), F.col("lon")).alias("region"))
    j = f.join(st, "target")
    return j.groupBy("region", "ring").agg(*V.contingency(F.col("fire"), F.col("truth")))


@query(
    f"""WITH RECURSIVE {_NEAR}, q AS (SELECT me.target, me.at_us, me.e, me.n, mo.ve, mo.vn, mo.ve * mo.ve + mo.vn * mo.vn AS a, 2 * (e * mo.ve + n * mo.vn) AS b, e * e + n * n - 100 AS c FROM me JOIN mo USING (target, at_us, cell)),
z AS (SELECT *, CASE WHEN c > 0 AND a >= 1e-9 AND b * b - 4 * a * c >= 0 THEN sqrt(b * b - 4 * a * c) END AS s FROM q)
SELECT target, at_us, round(min(CASE WHEN c <= 0 THEN 0 WHEN (-b - s) / (2 * a) >= 0 THEN (-b - s) / (2 * a) WHEN (-b + s) / (2 * a) >= 0 THEN (-b + s) / (2 * a) END), 3) + 0.0 AS entry_10 FROM z GROUP BY 1, 2"""
)
def strike_entry(spark: SparkSession, base: str) -> DataFrame:
    """When the first strike, carried on with its cell's motion, enters the ten-kilometre ring."""
    first = F.array_min(F.transform("cells", lambda x: x["entry_min"]))
    return seen(spark, base).select("target", "at_us", (F.round(first, 3) + 0.0).alias("entry_10"))


@query(
    f"""WITH {_STRIKES}, d AS (SELECT DISTINCT round(lat, 4) AS lat, round(lon, 4) AS lon, us // 1000000 AS sec FROM sk), k AS (SELECT *, sec // 86400 AS day, {_BOX} AS region, round(lat, 1) AS hlat, round(lon, 1) AS hlon FROM d)
SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(hlat) = 0 THEN 'heat' ELSE 'all' END AS level, day, region, hlat, hlon, count(*) AS n, max(sec) AS last, min(lat) AS south, max(lat) AS north FROM k GROUP BY GROUPING SETS ((day), (region), (hlat, hlon), ())"""
)
def strike_archive(spark: SparkSession, base: str) -> DataFrame:
    """Strikes written as JSON lines per day and read back; repeats by place and second dropped; totals per day, region, heat cell and in all in one pass."""
    path = scratch(spark) + "/strikes"
    s = strikes(spark, base).select("lat", "lon", instant(F.col("us")).alias("t"), F.floor(F.col("us") / F.lit(DAY_US)).alias("day"))
    s.write.partitionBy("day").json(path)
    back = spark.read.schema("lat double, lon double, t timestamp").json(path)
    d = back.select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.unix_seconds("t").alias("sec")).distinct()
    k = d.withColumns({"day": F.floor(F.col("sec") / 86400), "region": geo.region_box(F.col("lat"), F.col("lon")), "hlat": F.round("lat", 1), "hlon": F.round("lon", 1)})
    g = k.groupingSets([["day"], ["region"], ["hlat", "hlon"], []], "day", "region", "hlat", "hlon").agg(
        F.grouping("day").alias("gd"), F.grouping("region").alias("gr"), F.grouping("hlat").alias("gh"), F.count(F.lit(1)).alias("n"), F.max("sec").alias("last"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    level = F.when(F.col("gd") == 0, "day").when(F.col("gr") == 0, "region").when(F.col("gh") == 0, "heat").otherwise("all")
    return g.select(level.alias("level"), "day", "region", "hlat", "hlon", "n", "last", "south", "north")


@query(
    f"""WITH {_ST}, s AS (SELECT i, j FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE sqrt(i * 10.0 * i * 10.0 + j * 10.0 * j * 10.0) <= 30)
SELECT station_id AS anchor, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(lat + j * 10 / 110.574::DOUBLE, 6) AS lat, round(lon + i * 10 / (111.320 * cos(radians(lat))), 6) AS lon FROM st, s"""
)
def grid_targets(spark: SparkSession, base: str) -> DataFrame:
    """Targets every ten kilometres within thirty of each station."""
    g = L.grid_targets(present(spark, base).withColumnRenamed("station_id", "anchor"), 10.0, 30.0)
    return g.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})
