"""Queries of archives and catalogues: parsed stations, frames by name, coded groups, merged records, rate limits, harmonised products, random points, nested events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import DAY_US, MICROS, convective_season, iso_utc_us, micros
from slotweave.operators import blocks as B
from slotweave.operators import gauge as G
from slotweave.operators import harmonise as H
from slotweave.operators import models as M
from slotweave.operators import spatial
from slotweave.operators import verification as V
from slotweave.operators.matching import bursts
from slotweave.plans.gauges import _ONSETS, _SLOTS, _WARN, slots, warnings
from slotweave.plans.grids import _C
from slotweave.plans.modelling import curve_sql
from slotweave.plans.problems import sites
from slotweave.plans.problems_sql import _EDGES
from slotweave.plans.reports import _V, corpus, r6, valid
from slotweave.plans.scoring import _DRAW
from slotweave.runtime import cut, table
from slotweave.sources import geojson

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
    """SELECT station_id, CASE WHEN station_id IS NULL THEN 'no station' WHEN lat IS NULL OR lon IS NULL THEN 'no position' ELSE 'ok' END AS reason, name, round(lat, 6) AS lat, round(lon, 6) AS lon, epoch_us(date_trunc('second', operation_from)) AS from_us, coalesce(len(parameter_ids), -1) AS n_parameters FROM station_catalogue"""
)
def parsed_stations(spark: SparkSession, base: str) -> DataFrame:
    """The catalogue written as GeoJSON features and parsed back, with the reason where a row cannot be used."""
    p = geojson.parse_stations(geojson.write_stations(table(spark, base, "station_catalogue")))
    return p.select("station_id", "reason", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), micros("operation_from").alias("from_us"), F.coalesce(F.size("parameter_ids"), F.lit(-1)).alias("n_parameters"))


_NAMES = "nm AS (SELECT DISTINCT 'frame.' || strftime(CAST(CAST(event_time AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y%m%d%H%M') || '.h5' AS name FROM calibration_corpus), fl AS (SELECT name, epoch_us(strptime(regexp_extract(name, '(\\d{12})', 1), '%Y%m%d%H%M')) AS us FROM nm)"


@query(
    f"""WITH {_NAMES}, b AS (SELECT min(us) // 86400000000 AS a, max(us) // 86400000000 AS z FROM fl), g AS (SELECT d * 86400000000 + k * 600000000 AS us FROM b, LATERAL (SELECT unnest(range(a, z + 1)) AS d), range(144) t(k))
SELECT g.us // 86400000000 AS day, count(*) AS expected, count(fl.us) AS found, count(*) FILTER (fl.us IS NOT NULL AND (g.us // 60000000) % 10 = 0) AS full_range FROM g LEFT JOIN fl ON fl.us = g.us GROUP BY 1"""
)
def archive_frames(spark: SparkSession, base: str) -> DataFrame:
    """Frames listed by file name (stamp and kind from the name) against the grid of expected ones, by day."""
    t = F.to_timestamp("event_time")
    names = corpus(spark, base).select(F.concat(F.lit("frame."), F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyyMMddHHmm"), F.lit(".h5")).alias("name")).distinct()
    stamp = F.to_timestamp(F.concat(F.regexp_extract("name", r"(\d{12})", 1), F.lit("+0000")), "yyyyMMddHHmmZ")
    f = names.select(micros(stamp).alias("us"))
    span = f.agg(B.block_of(F.min("us"), DAY_US).alias("a"), B.block_of(F.max("us"), DAY_US).alias("z"))
    g = span.select(F.explode(F.sequence("a", "z")).alias("day")).select("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(143)), lambda k: F.col("day") * F.lit(DAY_US) + k.cast("long") * F.lit(10 * MIN))).alias("us"))
    j = g.join(f.withColumn("there", F.lit(True)), "us", "left")
    there = F.coalesce("there", F.lit(False))
    return j.groupBy("day").agg(F.count(F.lit(1)).alias("expected"), F.count_if(there).alias("found"), F.count_if(there & (F.pmod(F.floor(F.col("us") / F.lit(MIN)), F.lit(10)) == 0)).alias("full_range"))


@query(
    f"""WITH {_WARN}, cd AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS code FROM (SELECT DISTINCT station_id FROM station_catalogue WHERE operation_to IS NULL AND station_id IS NOT NULL))
SELECT warning_id, coalesce(CAST(code AS INTEGER), -1) AS code, CASE WHEN code IS NOT NULL THEN round(p_rain, 6) END AS p_scored, coalesce(eta_min, p_rain, lead_error_min) IS NOT NULL AS featured FROM w LEFT JOIN cd ON cd.station_id = w.sid"""
)
def coded_decisions(spark: SparkSession, base: str) -> DataFrame:
    """Stations as codes of the scored set, -1 for others, whose probability is left out; whether a row has any feature."""
    st = table(spark, base, "station_catalogue").where("operation_to is null and station_id is not null").select("station_id").distinct()
    codes = st.withColumn("code", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("station_id")) - 1).cast("int"))  # one row a station
    j = warnings(spark, base).join(codes, "station_id", "left")
    return j.select("warning_id", F.coalesce("code", F.lit(-1)).alias("code"), F.when(F.col("code").isNotNull(), F.round("p_rain", 6)).alias("p_scored"), F.coalesce("eta_min", "p_rain", "lead_error_min").isNotNull().alias("featured"))


@query(
    f"""WITH {_WARN}, {_SLOTS}, {_ONSETS}, j AS (SELECT n.station_id, n.onset_us, w.t_us, w.eta_min, row_number() OVER (PARTITION BY n.station_id, n.onset_us ORDER BY w.t_us DESC, w.eta_min DESC) AS k FROM n JOIN w ON w.sid = n.station_id AND w.t_us <= n.onset_us WHERE w.eta_min IS NOT NULL)
SELECT station_id, onset_us, t_us AS said_us, round(eta_min, 6) AS eta_min FROM j WHERE k = 1"""
)
def latest_estimates(spark: SparkSession, base: str) -> DataFrame:
    """The last announced time of arrival before each onset, however long ago."""
    on = G.onsets(slots(spark, base)).select("station_id", "onset_us")
    w = warnings(spark, base).where("eta_min is not null").select("station_id", F.col("t_us").alias("at"), F.struct("t_us", "eta_min").alias("said"))
    j = B.last_before(on, w, key="station_id", left_us="onset_us", right_us="at", value="said", width=G.BLOCK_US).where("said is not null")
    return j.select("station_id", "onset_us", F.col("said.t_us").alias("said_us"), F.round("said.eta_min", 6).alias("eta_min"))


@query(
    """SELECT station_id, arg_max(name, (fetched_utc, snapshot_id)) FILTER (name IS NOT NULL) AS name, round(arg_max(station_height, (fetched_utc, snapshot_id)) FILTER (station_height IS NOT NULL), 6) AS height, arg_max(status, (fetched_utc, snapshot_id)) FILTER (status IS NOT NULL) AS status, count(*) AS n FROM station_snapshots WHERE fetched_utc IS NOT NULL GROUP BY 1"""
)
def merged_records(spark: SparkSession, base: str) -> DataFrame:
    """Keyed partial updates: of every field the last value that was given."""
    at = F.struct("fetched_utc", "snapshot_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    g = table(spark, base, "station_snapshots").where("fetched_utc is not null").groupBy("station_id")
    return g.agg(last("name").alias("name"), F.round(last("station_height"), 6).alias("height"), last("status").alias("status"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {_WARN}, o AS (SELECT sid, t_us, warning_id, row_number() OVER (PARTITION BY sid ORDER BY t_us, warning_id) AS k FROM w),
r AS (SELECT sid, k, t_us, warning_id, 2.0::DOUBLE AS left_, true AS ok FROM o WHERE k = 1 UNION ALL SELECT o.sid, o.k, o.t_us, o.warning_id, CASE WHEN f >= 1 THEN f - 1 ELSE f END, f >= 1 FROM (SELECT r.sid AS rs, r.k AS rk, o.*, least(3.0, r.left_ + (o.t_us - r.t_us) / 1.8e9) AS f FROM r JOIN o ON o.sid = r.sid AND o.k = r.k + 1) o)
SELECT warning_id, ok FROM r"""
)
def rate_limited(spark: SparkSession, base: str) -> DataFrame:
    """A token bucket per station (three, one more every thirty minutes): a pause that fills the bucket ends a burst, so a group is a burst."""
    rows = bursts(warnings(spark, base).select("station_id", F.col("t_us").alias("us"), "warning_id"), "station_id", "us", 90)

    def work(t: pa.Table) -> pa.Table:
        out, run, left, last = [], None, 3.0, 0
        for b, u, i in sorted(zip(*(t.column(c).to_pylist() for c in ("burst", "us", "warning_id")))):
            left = 3.0 if b != run else min(3.0, left + (u - last) / 1.8e9)
            run, last = b, u
            out.append((i, left >= 1))
            left -= left >= 1
        return pa.table({"warning_id": pa.array([x[0] for x in out], pa.int64()), "ok": pa.array([x[1] for x in out], pa.bool_())})

    return rows.groupBy("station_id", "block").applyInArrow(work, "warning_id long, ok boolean")


@query(
    f"""WITH {_C}, x AS (SELECT k * 5 AS lead, t AS threshold, r[CAST(k AS BIGINT)] >= t AS f, r[CAST(8 + k AS BIGINT)] >= t AS o FROM c, range(1, 9) a(k), (SELECT unnest([0.5, 2.0, 4.0])::DOUBLE AS t)),
n AS (SELECT CAST(lead AS INTEGER) AS lead, threshold, count(*) FILTER (f AND o) AS hits, count(*) FILTER (NOT f AND o) AS misses, count(*) FILTER (f AND NOT o) AS false_alarms, count(*) FILTER (NOT f AND NOT o) AS correct FROM x GROUP BY 1, 2)
SELECT *, round(hits / nullif(hits + misses + false_alarms, 0)::DOUBLE, 6) AS csi, round((hits + false_alarms) / nullif(hits + misses, 0)::DOUBLE, 6) AS bias FROM n"""
)
def horizon_scores(spark: SparkSession, base: str) -> DataFrame:
    """Cell counts of one member against another at every step and threshold, pooled over the grid, with scores from the counts."""
    from slotweave.plans.grids import cells

    m = cells(spark, base).select(F.get("members", F.lit(0)).alias("a"), F.get("members", F.lit(1)).alias("b"))
    step = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(((k + 1) * 5).alias("lead"), F.get("a", k).alias("f"), F.get("b", k).alias("o"))))
    x = m.select(step.alias("x")).select("x.*", F.explode(F.array(*[F.lit(t) for t in (0.5, 2.0, 4.0)])).alias("threshold"))
    g = x.groupBy("lead", "threshold").agg(*V.contingency(F.col("f") >= F.col("threshold"), F.col("o") >= F.col("threshold")))
    s = V.table_scores()
    return g.withColumns({"csi": F.round(s["csi"], 6), "bias": F.round(s["bias"], 6)})


@query(
    f"""WITH {_EDGES}, bx AS (SELECT region, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM ed GROUP BY 1), cd AS (SELECT region, i, x0 + {_DRAW("'21'", "region", "CAST(i AS VARCHAR)")} * (x1 - x0) AS lon,
 degrees(asin(sin(radians(y0)) + {_DRAW("'22'", "region", "CAST(i AS VARCHAR)")} * (sin(radians(y1)) - sin(radians(y0))))) AS lat FROM bx, range(200) t(i)),
io AS (SELECT cd.region, i, lat, lon FROM cd JOIN ed ON ed.region = cd.region AND (ed.ay > lat) <> (ed.by_ > lat) AND lon < (ed.bx - ed.ax) * (lat - ed.ay) / (ed.by_ - ed.ay) + ed.ax GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)
SELECT region, CAST(i AS INTEGER) AS i, round(lat, 6) AS lat, round(lon, 6) AS lon FROM io"""
)
def random_points(spark: SparkSession, base: str) -> DataFrame:
    """Two hundred draws per region, uniform by area on the sphere, kept where they lie inside the outline (a sampling operator)."""
    areas = sites(spark, base).where("kind = 'region'")
    v = lambda c: F.flatten(c)
    b = areas.select(F.col("id").alias("region"), F.array_min(v("rings_lon")).alias("x0"), F.array_max(v("rings_lon")).alias("x1"), F.array_min(v("rings_lat")).alias("y0"), F.array_max(v("rings_lat")).alias("y1"))
    c = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(199))))
    lo, hi = F.sin(F.radians("y0")), F.sin(F.radians("y1"))
    c = c.select("region", "i", (F.col("x0") + V.hash_draw(F.col("region"), F.col("i"), seed=21) * (F.col("x1") - F.col("x0"))).alias("lon"), F.degrees(F.asin(lo + V.hash_draw(F.col("region"), F.col("i"), seed=22) * (hi - lo))).alias("lat"))
    c = cut(c.withColumn("point_id", F.concat_ws("|", "region", "i")))
    inside = spatial.match_sites(c, areas).where(F.col("found_id") == F.substring_index("point_id", "|", 1)).select("point_id")
    return c.join(inside, "point_id").select("region", "i", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    f"""WITH {_V}, e AS (SELECT event_time, row_number() OVER (ORDER BY event_time) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_time FROM b)), x AS (SELECT b.lead_min, bin, p, y, w, k <= floor(n * 0.66) AS train FROM b JOIN e USING (event_time)),
c AS (SELECT lead_min, bin, sum(w * y) / sum(w) AS q FROM x WHERE train GROUP BY 1, 2) SELECT x.lead_min, count(*) AS n, round(sum(w * (p - y) * (p - y)) / sum(w), 6) AS brier_raw, round(sum(w * (coalesce(q, p) - y) * (coalesce(q, p) - y)) / sum(w), 6) AS brier_calibrated FROM x LEFT JOIN c USING (lead_min, bin) WHERE NOT train GROUP BY 1"""
)
def calibration_holdout(spark: SparkSession, base: str) -> DataFrame:
    """Calibrated on the first two thirds of the events in time, scored on the rest."""
    return holdout(valid(spark, base))


def holdout(v: DataFrame) -> DataFrame:
    """``v``: ``event_time, lead_min, p, y, w``. Read once, as sums per event, lead and bin; events are in order of their text, one without time counts among them but is in neither part."""
    w, p, y, q = F.col("w"), F.col("p"), F.col("y"), F.col("q")
    g = v.groupBy("event_time", "lead_min", V.bin_of(p).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.sum(w * F.pow(p - y, 2)).alias("raw"))
    g = cut(g)
    events = g.select("event_time").distinct()
    # numbered day by day, with the days before carried
    e = B.running_sums(events.where("event_time is not null").withColumn("g", F.lit(1)), ["g"], [F.col("event_time")], F.substring("event_time", 1, 10), {"k": F.lit(1)})
    n = events.agg(F.count(F.lit(1)).alias("n_events"))  # one row
    last = e.join(F.broadcast(n)).where(F.col("k") <= F.floor(F.col("n_events") * 0.66)).agg(F.max("event_time").alias("last"))  # one row
    x = g.where("event_time is not null").join(F.broadcast(last)).withColumn("train", F.coalesce(F.col("event_time") <= F.col("last"), F.lit(False)))
    c = x.where("train").groupBy("lead_min", "bin").agg((F.sum("wy") / F.sum("w")).alias("q"))
    t = x.where("not train").join(F.broadcast(c), ["lead_min", "bin"], "left")  # ten rows a lead
    off = F.when(q.isNull(), F.col("raw")).otherwise(q * q * w - 2 * q * F.col("wy") + F.col("wyy"))
    return r6(t.groupBy("lead_min").agg(F.sum("n").alias("n"), V.ratio(F.sum("raw"), F.sum(w)).alias("brier_raw"), V.ratio(F.sum(off), F.sum(w)).alias("brier_calibrated")), "brier_raw", "brier_calibrated")


_CAL = lambda t, g: f"(SELECT CASE WHEN sv.p < x OR x1 IS NULL THEN y ELSE y + (y1 - y) * (sv.p - x) / (x1 - x) END FROM {t} t WHERE t.g = sv.{g} AND (t.x <= sv.p OR t.k = 1) ORDER BY t.x DESC LIMIT 1)"


@query(
    f"""WITH {_V}, sv AS (SELECT coalesce(region, 'none') AS region, p, y, 'all' AS allg FROM b), {curve_sql("ca", "allg", 1)}, {curve_sql("cr", "region", 300)}, r AS (SELECT sv.*, {_CAL("ca", "allg")} AS pa, {_CAL("cr", "region")} AS pr FROM sv)
SELECT region, CASE WHEN count(pr) > 0 THEN 'own' ELSE 'pooled' END AS curve, count(*) AS n, round(avg(coalesce(pr, pa)), 6) AS mean_calibrated, round(avg(y), 6) AS freq FROM r GROUP BY 1"""
)
def region_calibration(spark: SparkSession, base: str) -> DataFrame:
    """Probabilities by their region's curve, by the pooled one where a region has too few rows; the curves pass through one JSON document."""
    v = valid(spark, base).select(F.coalesce("region", F.lit("none")).alias("region"), "p", "y")
    own = M.binned_curves(v, ["region"], bins=10, least=300)
    pooled = M.binned_curves(v.withColumn("region", F.lit("*")), ["region"], bins=10)
    doc = own.unionByName(pooled).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("region", F.struct("xs", "ys"))))).alias("doc"))  # a row a region
    curves = doc.select(F.explode(F.from_json("doc", "map<string, struct<xs: array<double>, ys: array<double>>>")).alias("key", "c"))
    mine = v.join(curves.withColumnRenamed("key", "region"), "region", "left").join(F.broadcast(curves.where("key = '*'").select(F.col("c").alias("a"))))  # one row
    q = F.coalesce(M.interpolated(F.col("p"), F.col("c.xs"), F.col("c.ys")), M.interpolated(F.col("p"), F.col("a.xs"), F.col("a.ys")))
    g = mine.withColumn("q", q).groupBy("region").agg(F.when(F.count("c") > 0, "own").otherwise("pooled").alias("curve"), F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_calibrated"), F.avg("y").alias("freq"))
    return r6(g, "mean_calibrated", "freq")


@query(
    f"""WITH {_WARN}, {_SLOTS}, pb AS (SELECT warning_id, sid, unnest(range((t_us - 3599999999) + ((-(t_us - 3599999999)) % 600000000 + 600000000) % 600000000, t_us + 3600000001, 600000000)) AS slot_us FROM w),
ge AS (SELECT warning_id, count(*) AS n_slots, count(s.wet) AS n_known, round(sum(s.mm), 6) AS mm FROM pb LEFT JOIN s ON pb.sid = s.station_id AND pb.slot_us = s.slot_us GROUP BY 1)
SELECT w.warning_id, coalesce(outcome, 'none') AS outcome, CAST(n_slots AS INTEGER) AS n_slots, CAST(n_known AS INTEGER) AS n_known, mm FROM w JOIN ge USING (warning_id)"""
)
def event_documents(spark: SparkSession, base: str) -> DataFrame:
    """Each warning with the slots of two hours around it as one nested JSON document, read back and summed up."""
    w = warnings(spark, base)
    lo = F.col("t_us") - F.lit(60 * MIN) + 1
    probe = w.select("warning_id", "station_id", "outcome", "t_us", F.explode(F.sequence(lo + F.pmod(-lo, F.lit(10 * MIN)), F.col("t_us") + F.lit(60 * MIN), F.lit(10 * MIN))).alias("slot_us"))
    met = probe.join(slots(spark, base).select("station_id", "slot_us", "mm", "wet"), ["station_id", "slot_us"], "left")
    series = F.sort_array(F.collect_list(F.struct(F.col("slot_us"), "wet", "mm")))  # twelve slots
    d = met.groupBy("warning_id", "station_id", "outcome", "t_us").agg(series.alias("slots"))
    doc = d.select("warning_id", F.to_json(F.struct("station_id", F.coalesce("outcome", F.lit("none")).alias("outcome"), iso_utc_us(F.col("t_us")).alias("anchor"), "slots")).alias("doc"))
    back = doc.select("warning_id", F.from_json("doc", "station_id string, outcome string, anchor string, slots array<struct<slot_us: long, wet: boolean, mm: double>>").alias("d"))
    mm = F.filter("d.slots", lambda x: x["mm"].isNotNull())
    total = F.when(F.size(mm) > 0, F.round(F.aggregate(mm, F.lit(0.0), lambda a, x: a + x["mm"]), 6))
    return back.select("warning_id", "d.outcome", F.size("d.slots").alias("n_slots"), F.size(F.filter("d.slots", lambda x: x["wet"].isNotNull())).alias("n_known"), total.alias("mm"))


@query()
def harmonised_values(spark: SparkSession, base: str) -> DataFrame:
    """Minutes of rain in a slot brought onto the distribution of its depth, per season, by a quantile map, with how many slots reach a depth before and after. Held against numpy in the tests."""
    d = cut(slots(spark, base).where("mm is not null and dur is not null").select(convective_season(F.month(F.timestamp_micros("slot_us"))).alias("season"), "mm", "dur"))
    maps = H.fit_maps(H.histogram(d, ["season"], ["dur", "mm"], 0.0, 0.1, 121), ["season"], "dur", "mm", 0.0, 0.1, 121, least=10)
    j = d.join(F.broadcast(maps), "season", "left").withColumn("mapped", H.mapped(F.col("dur"), F.col("xs"), F.col("ys"), 0.1))  # a row a season
    over = lambda c, t: F.count_if(F.col(c) >= t)
    return j.groupBy("season").agg(F.count(F.lit(1)).alias("n"), *[F.round(V.ratio(over(c, t), over("mm", t)), 6).alias(f"{n}_{k}") for k, t in (("light", 0.2), ("heavy", 1.0)) for n, c in (("before", "dur"), ("after", "mapped"))])
