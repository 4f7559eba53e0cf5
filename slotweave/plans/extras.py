"""Further queries: lookups, features, sets, retention, distributions, models and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import MICROS, micros
from slotweave.operators import features as X
from slotweave.operators import gauge as G
from slotweave.operators import spatial
from slotweave.operators import verification as V
from slotweave.plans.gauges import _ONSETS, _SLOTS, _WARN, present, slots, warnings
from slotweave.plans.grids import _C, cells
from slotweave.plans.problems import corpus_points, sites
from slotweave.plans.problems_sql import _EDGES, _INSIDE, _POINTS
from slotweave.plans.reports import _V, r6, valid
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


@query(
    f"""WITH {_WARN}, {_SLOTS}, {_ONSETS}, j AS (SELECT warning_id, onset_us, depth, row_number() OVER (PARTITION BY warning_id ORDER BY abs(onset_us - t_us), onset_us) AS k FROM w JOIN n ON w.sid = n.station_id AND abs(onset_us - t_us) <= 3600000000)
SELECT w.warning_id, onset_us AS found_us, round(depth, 6) AS found FROM w LEFT JOIN j ON w.warning_id = j.warning_id AND k = 1"""
)
def nearest_onset(spark: SparkSession, base: str) -> DataFrame:
    """Nearest onset before or after each warning within an hour."""
    o = G.onsets(slots(spark, base))
    return r6(X.nearest_within(warnings(spark, base), o, key="station_id", left_us="t_us", right_us="onset_us", value="depth", row_id=["warning_id"], within_min=60), "found")


@query(
    """WITH f AS (SELECT scan_type, epoch_us(CAST(event_time AS TIMESTAMPTZ)) AS us, CASE scan_type WHEN 'fullRange' THEN 786000000 ELSE 486000000 END AS lag FROM calibration_corpus WHERE scan_type IS NOT NULL GROUP BY 1, 2),
p AS (SELECT DISTINCT epoch_us(warned_at_utc) AS now FROM warnings_scored WHERE warned_at_utc IS NOT NULL),
k AS (SELECT now, us, scan_type, row_number() OVER (PARTITION BY now ORDER BY us DESC, scan_type DESC) AS r FROM p JOIN f ON us + lag <= now AND now - us <= 3600000000)
SELECT p.now, us AS anchor_us, scan_type FROM p LEFT JOIN k ON p.now = k.now AND r = 1"""
)
def select_anchor(spark: SparkSession, base: str) -> DataFrame:
    """The newest frame already published at an instant, at most an hour old; fullRange wins ties."""
    f = table(spark, base, "calibration_corpus").where("scan_type is not null").select("scan_type", (F.unix_timestamp(F.to_timestamp("event_time")) * MICROS).alias("us")).distinct()
    f = f.withColumn("lag", F.when(F.col("scan_type") == "fullRange", F.lit(786 * MICROS)).otherwise(F.lit(486 * MICROS)))
    p = table(spark, base, "warnings_scored").where("warned_at_utc is not null").select(micros("warned_at_utc").alias("now")).distinct()
    hour = F.lit(3600 * MICROS)
    b = F.floor(F.col("now") / hour)
    probe = p.select("now", F.explode(F.array(b - 1, b)).alias("b"))
    j = probe.join(f.withColumn("b", F.floor(F.col("us") / hour)), "b", "left")
    ok = (F.col("us") + F.col("lag") <= F.col("now")) & (F.col("now") - F.col("us") <= hour)
    return j.groupBy("now").agg(F.max(F.when(ok, F.struct("us", "scan_type"))).alias("m")).select("now", F.col("m.us").alias("anchor_us"), F.col("m.scan_type").alias("scan_type"))


@query(
    f"""WITH {_WARN}, m AS (SELECT avg(p_rain) AS mp, stddev_pop(p_rain) AS sp, avg(eta_min) AS me, stddev_pop(eta_min) AS se FROM w)
SELECT warning_id, round(coalesce((p_rain - mp) / sp, 0.0), 6) + 0.0 AS z_p_rain, round(coalesce((eta_min - me) / se, 0.0), 6) + 0.0 AS z_eta_min FROM w, m"""
)
def standardised_features(spark: SparkSession, base: str) -> DataFrame:
    z = X.standardise(warnings(spark, base).select("warning_id", "p_rain", "eta_min"), ["p_rain", "eta_min"])
    return z.select("warning_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("z_p_rain", "z_eta_min")])


@query(
    f"""WITH {_WARN}, d AS (SELECT warning_id, eta_min AS x FROM w WHERE eta_min IS NOT NULL), c AS (SELECT warning_id, pow(greatest(x - 5, 0.0), 3) AS a, pow(greatest(x - 15, 0.0), 3) AS b, pow(greatest(x - 30, 0.0), 3) AS c, pow(greatest(x - 60, 0.0), 3) AS d FROM d)
SELECT warning_id, round((a - d) / 55.0 - (c - d) / 30.0, 4) + 0.0 AS s0, round((b - d) / 45.0 - (c - d) / 30.0, 4) + 0.0 AS s1 FROM c"""
)
def spline_features(spark: SparkSession, base: str) -> DataFrame:
    s = X.spline_basis(F.col("eta_min"), [5.0, 15.0, 30.0, 60.0])
    return warnings(spark, base).where("eta_min is not null").select("warning_id", *[(F.round(c, 4) + 0.0).alias(f"s{i}") for i, c in enumerate(s)])


@query(
    f"""WITH RECURSIVE {_WARN}, v AS (SELECT warning_id, sid, t_us, eta_min AS x FROM w WHERE eta_min IS NOT NULL AND NOT isnan(eta_min)), d AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY sid ORDER BY t_us) > 7200000000 THEN 1 ELSE 0 END AS nw FROM v),
b AS (SELECT *, sum(nw) OVER (PARTITION BY sid ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY sid, run ORDER BY t_us, warning_id) AS k FROM b),
r AS (SELECT sid, run, k, t_us, warning_id, x AS s FROM o WHERE k = 1 UNION ALL SELECT o.sid, o.run, o.k, o.t_us, o.warning_id, r.s + (1 - pow(0.5, (o.t_us - r.t_us) / 1.8e9)) * (o.x - r.s) FROM r JOIN o ON o.sid = r.sid AND o.run = r.run AND o.k = r.k + 1)
SELECT warning_id, round(s, 6) AS smooth FROM r"""
)
def smoothed_eta(spark: SparkSession, base: str) -> DataFrame:
    """Announced times smoothed per station, started anew after two hours."""
    s = X.smoothed(warnings(spark, base), key="station_id", us="t_us", row_id="warning_id", value="eta_min", half_min=30.0, reset_min=120)
    return s.select(F.col("row_id").alias("warning_id"), F.round("smooth", 6).alias("smooth"))


_CELLS = f"""{_V}, g AS (SELECT lead_min, bin, count(*) AS n, round(sum(w * y) / sum(w), 6) AS v, point_set FROM b GROUP BY lead_min, bin, point_set)"""


@query(
    f"""WITH {_CELLS}, o AS (SELECT lead_min * 100 + bin AS k, v FROM g WHERE point_set = 'national'), n AS (SELECT lead_min * 100 + bin AS k, v, n FROM g WHERE point_set = 'gauge')
SELECT k, CASE WHEN n.v IS NULL OR (o.v IS NOT NULL AND NOT (abs(n.v - o.v) >= 0.02 AND n >= 30)) THEN o.v ELSE n.v END AS v, NOT (n.v IS NULL OR (o.v IS NOT NULL AND NOT (abs(n.v - o.v) >= 0.02 AND n >= 30))) AND o.v IS NOT NULL AS changed FROM o FULL JOIN n USING (k)"""
)
def stability_guard(spark: SparkSession, base: str) -> DataFrame:
    """A table of values updated only where the change is large enough and well founded."""
    r = r6(V.reliability(valid(spark, base), ["point_set", "lead_min"]), "freq").select("point_set", (F.col("lead_min") * 100 + F.col("bin")).alias("k"), F.col("freq").alias("v"), "n")
    return X.guarded_update(r.where("point_set = 'national'"), r.where("point_set = 'gauge'"), "k", "v", "n", 0.02, 30)


@query(
    """WITH f AS (SELECT doc_id, n_chars, modified_utc FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT *, sum(n_chars) OVER (ORDER BY date_trunc('day', modified_utc) DESC NULLS LAST, modified_utc DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT doc_id, s > 1000000 AS evict FROM r"""
)
def cache_eviction(spark: SparkSession, base: str) -> DataFrame:
    """Documents beyond the first million characters in order of last use."""
    f = table(spark, base, "documents").where("n_chars is not null").select("doc_id", "n_chars", "modified_utc")
    return X.eviction(f, "n_chars", "modified_utc", "doc_id", 1_000_000).select("doc_id", "evict")


@query(
    f"""WITH {_C}, p AS (SELECT vec_id AS id, row, col FROM c), j AS (SELECT p.id, p.col - g.col AS s, g.v FROM p JOIN (SELECT g.*, unnest(range(g.row - 1, g.row + 2)) AS near FROM g) g ON p.row = g.near AND g.col BETWEEN p.col - 8 AND p.col - 1)
SELECT id, round(max(v) FILTER (s * 2 <= 8), 6) AS near_max, round(max(v), 6) AS far_max, min(s) FILTER (v >= 0.5) AS first_echo, round(avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS wet_share, round(avg(v), 6) AS mean, count(v) AS n FROM j GROUP BY 1"""
)
def upstream_corridor(spark: SparkSession, base: str) -> DataFrame:
    g = cells(spark, base)
    return r6(X.corridor(g, g.select(F.col("vec_id").alias("id"), "row", "col"), length=8, width=1, value="v", threshold=0.5), "near_max", "far_max", "wet_share", "mean")


@query(
    """WITH h AS (SELECT parameter_id, least(greatest(CAST(floor((CAST(value AS DOUBLE) + 10) / 1.0) AS INTEGER), 0), 39) AS bin FROM observations WHERE isfinite(value)), c AS (SELECT parameter_id, bin, count(*) AS n FROM h GROUP BY 1, 2)
SELECT parameter_id, bin, n, round(sum(n) OVER (PARTITION BY parameter_id ORDER BY bin DESC) / sum(n) OVER (PARTITION BY parameter_id)::DOUBLE, 6) AS exceedance FROM c"""
)
def histogram_exceedance(spark: SparkSession, base: str) -> DataFrame:
    """Fixed-width histogram per parameter and the share at or above each bin."""
    o = table(spark, base, "observations").where(V.finite(F.col("value")))
    bin_ = F.least(F.greatest(F.floor(F.col("value").cast("double") + 10).cast("int"), F.lit(0)), F.lit(39))
    c = o.groupBy("parameter_id", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("parameter_id")
    return c.withColumn("exceedance", F.round(F.sum("n").over(w.orderBy(F.col("bin").desc())) / F.sum("n").over(w), 6))


@query(
    """WITH t AS (SELECT station_id, date_trunc('hour', observed_utc) AS h, avg(CAST(value AS DOUBLE)) AS v FROM observations WHERE parameter_id = 'temp_dry' AND value BETWEEN -40 AND 45 GROUP BY 1, 2),
c AS (SELECT k AS lag_h, corr(a.v, b.v) AS r FROM range(1, 13) q(k), t a JOIN t b ON a.station_id = b.station_id AND b.h = a.h + k * INTERVAL 1 HOUR GROUP BY 1) SELECT CAST(lag_h AS INTEGER) AS lag_h, round(r, 4) AS r FROM c"""
)
def lag_correlation(spark: SparkSession, base: str) -> DataFrame:
    """Autocorrelation of hourly means at lags of one to twelve hours: each hour meets its later hours by an equi-join."""
    t = table(spark, base, "observations").where("parameter_id = 'temp_dry' and value between -40 and 45").groupBy("station_id", F.floor(micros("observed_utc") / F.lit(3600 * MICROS)).alias("h")).agg(F.avg(F.col("value").cast("double")).alias("v"))
    a = t.select("station_id", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("lag_h"), (F.col("h") + k).alias("h")) for k in range(1, 13)])).alias("x")).select("station_id", F.col("v").alias("a"), "x.lag_h", "x.h")
    return a.join(t, ["station_id", "h"]).groupBy("lag_h").agg(F.round(F.corr("a", "v"), 4).alias("r"))


@query(
    f"""WITH {_WARN}, k AS (SELECT sid AS station_id, t_us // 86400000000 AS day, warning_id, p_rain, row_number() OVER (PARTITION BY sid, t_us // 86400000000 ORDER BY p_rain DESC NULLS LAST, t_us, warning_id) AS r FROM w)
SELECT station_id, CAST(day AS BIGINT) AS day, warning_id, round(p_rain, 6) AS p FROM k WHERE r = 1"""
)
def peak_probability(spark: SparkSession, base: str) -> DataFrame:
    """The highest probability of each station and day, the earliest on ties: a maximum of structs, no sort."""
    w = warnings(spark, base).withColumn("day", F.floor(F.col("t_us") / F.lit(86400 * MICROS)))
    best = F.max(F.struct(F.coalesce("p_rain", F.lit(-1.0)).alias("p"), (-F.col("t_us")).alias("t"), (-F.col("warning_id")).alias("i")))
    return w.groupBy("station_id", "day").agg(best.alias("m")).select("station_id", "day", (-F.col("m.i")).alias("warning_id"), F.round(F.when(F.col("m.p") >= 0, F.col("m.p")), 6).alias("p"))


@query(
    """WITH c AS (SELECT station_id, lon FROM station_catalogue WHERE operation_to IS NULL AND station_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL) SELECT station_id, CAST((row_number() OVER (ORDER BY lon, station_id) - 1) % 5 AS INTEGER) AS fold FROM c"""
)
def spatial_folds(spark: SparkSession, base: str) -> DataFrame:
    """Stations dealt round by longitude into five hold-out groups (one row a station)."""
    return present(spark, base).select("station_id", ((F.row_number().over(W.partitionBy(F.lit(1)).orderBy("lon", "station_id")) - 1) % 5).alias("fold"))


@query(
    """WITH a AS (SELECT DISTINCT station_id, parameter_id FROM observations WHERE station_id IS NOT NULL), b AS (SELECT DISTINCT station_id, unnest(parameter_ids) AS parameter_id FROM station_catalogue WHERE station_id IS NOT NULL)
SELECT 'unlisted' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'silent', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def symmetric_difference(spark: SparkSession, base: str) -> DataFrame:
    """What stations report and do not list, and the other way round."""
    a = table(spark, base, "observations").where("station_id is not null").select("station_id", "parameter_id").distinct()
    b = table(spark, base, "station_catalogue").where("station_id is not null").select("station_id", F.explode("parameter_ids").alias("parameter_id")).distinct()
    side = lambda d, n: d.select(F.lit(n).alias("side"), "station_id", "parameter_id")
    return side(a.subtract(b), "unlisted").unionByName(side(b.subtract(a), "silent"))


@query(
    f"""WITH {_POINTS}, {_EDGES}, {_INSIDE}, k AS (SELECT io.point_id, io.region, (io.lon - ax) * cos(radians(io.lat)) AS px, io.lat - ay AS py, (bx - ax) * cos(radians(io.lat)) AS dx, by_ - ay AS dy FROM io JOIN ed USING (region)),
t AS (SELECT *, greatest(0.0, least(1.0, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM k)
SELECT point_id, region, round(min(sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) * 111.195), 6) AS km FROM t GROUP BY 1, 2"""
)
def distance_to_border(spark: SparkSession, base: str) -> DataFrame:
    """For each corpus point its region and the distance to the region's outline: points meet the edges of their own region only."""
    inside = spatial.match_sites(corpus_points(spark, base), sites(spark, base).where("kind = 'region'")).select("point_id", F.col("found_id").alias("region"))
    pts = corpus_points(spark, base).where("lat is not null and lon is not null").distinct()
    ring = table(spark, base, "region_areas").select("region", "ring_no", F.posexplode(F.arrays_zip(F.col("ring_lon").alias("lon"), F.col("ring_lat").alias("lat"))).alias("i", "p"), F.size("ring_lon").alias("n"))
    a = ring.select("region", "ring_no", "i", "n", F.col("p.lon").alias("ax"), F.col("p.lat").alias("ay"))
    b = ring.select("region", "ring_no", ((F.col("i") + F.col("n") - 1) % F.col("n")).alias("i"), F.col("p.lon").alias("bx"), F.col("p.lat").alias("by"))
    edges = a.join(b, ["region", "ring_no", "i"]).select("region", "ax", "ay", "bx", "by")
    j = pts.join(inside, "point_id").join(edges, "region")
    k = F.cos(F.radians("lat"))
    px, py, dx, dy = (F.col("lon") - F.col("ax")) * k, F.col("lat") - F.col("ay"), (F.col("bx") - F.col("ax")) * k, F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(V.ratio(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    km = F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)) * 111.195
    return j.groupBy("point_id", "region").agg(F.round(F.min(km), 6).alias("km"))


@query(
    f"""WITH {_V}, bs AS (SELECT lead_min, bin, count(*) AS n, sum(w) AS sw, sum(w * p) / sum(w) AS mp, sum(w * y) / sum(w) AS my FROM b GROUP BY 1, 2), ls AS (SELECT lead_min, count(*) AS n, sum(w * y) / sum(w) AS base, sum(w * (p - y) * (p - y)) / sum(w) AS brier FROM b GROUP BY 1)
SELECT lead_min, ls.n AS n, round(base, 6) AS base_rate, round(brier, 6) AS brier, CAST(count(*) AS INTEGER) AS n_bins, max(bs.n) AS fullest, round(max(my), 6) AS top_freq, true AS valid FROM ls JOIN bs USING (lead_min) GROUP BY 1, 2, 3, 4"""
)
def quality_document(spark: SparkSession, base: str) -> DataFrame:
    """The report as one nested JSON document per lead (curve, parts of the score, ranking), read back by its schema and checked."""
    v = valid(spark, base)
    curve = V.reliability(v, ["lead_min"]).groupBy("lead_min").agg(F.sort_array(F.collect_list(F.struct("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("freq", 6).alias("freq")))).alias("curve"))  # ten bins at most
    j = curve.join(V.murphy(v, ["lead_min"]), "lead_min").join(V.ranking(v, ["lead_min"]), "lead_min")
    doc = F.struct("lead_min", "n", F.struct(*[F.round(c, 6).alias(c) for c in ("base_rate", "brier", "reliability", "resolution", "uncertainty", "bss")]).alias("scores"), F.struct(*[F.round(c, 6).alias(c) for c in ("roc_auc", "pr_auc", "best_f1")]).alias("ranking"), "curve")
    text = j.select("lead_min", F.to_json(doc).alias("document"))
    d = text.select("lead_min", F.from_json("document", "n long, scores struct<base_rate: double, brier: double>, ranking struct<roc_auc: double, pr_auc: double>, curve array<struct<bin: int, n: long, mean_p: double, freq: double>>").alias("d"))
    whole = F.aggregate("d.curve", F.lit(0).cast("long"), lambda a, x: a + x["n"]) == F.col("d.n")
    return d.select("lead_min", "d.n", "d.scores.base_rate", "d.scores.brier", F.size("d.curve").alias("n_bins"), F.array_max("d.curve.n").alias("fullest"), F.array_max("d.curve.freq").alias("top_freq"), (whole & (F.col("d.ranking.roc_auc").isNull() | F.col("d.ranking.roc_auc").between(0, 1))).alias("valid"))
