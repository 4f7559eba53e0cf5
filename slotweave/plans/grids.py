"""Queries over ensembles and grids (the embeddings table read as cells), scalar functions, motion and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import rain
from slotweave.functions.timeexpr import MICROS, convective_season, micros, rounded_slot_sec, slot_end_us
from slotweave.operators import ensemble as E
from slotweave.operators import verification as V
from slotweave.plans.gauges import _ST, _WARN, present, warnings
from slotweave.plans.reports import r6
from slotweave.runtime import table
from slotweave.sources import geojson, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cells(spark: SparkSession, base: str) -> DataFrame:
    """A grid 50 cells wide; each cell's 64 numbers are 8 members of 8 steps."""
    e = table(spark, base, "embeddings").withColumn("rate", F.transform("embedding", lambda x: F.greatest(F.lit(0.0), x.cast("double") * 4)))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda m: F.slice("rate", m * 8 + 1, 8))
    return e.select("vec_id", F.floor(F.col("vec_id") / 50).cast("int").alias("row"), (F.col("vec_id") % 50).cast("int").alias("col"), rows.alias("members"), F.get("rate", F.lit(0)).alias("v"), F.get("rate", F.lit(1)).alias("u"), F.col("label"))


_C = """c AS (SELECT vec_id, CAST(floor(vec_id / 50) AS INTEGER) AS row, CAST(vec_id % 50 AS INTEGER) AS col, list_transform(embedding, lambda x: greatest(0.0, CAST(x AS DOUBLE) * 4)) AS r, label FROM embeddings),
g AS (SELECT vec_id, row, col, r[1] AS v, r[2] AS u, label FROM c)"""


@query(
    f"""WITH {_C}, x AS (SELECT vec_id, m, k, r[CAST(m * 8 + k AS BIGINT)] AS q FROM c, range(8) a(m), range(1, 9) b(k)),
f AS (SELECT vec_id, m, min(k) FILTER (q >= 0.5) AS k FROM x GROUP BY 1, 2), n AS (SELECT vec_id, s, count(*) FILTER (k <= s) / 8.0 AS p FROM f, range(1, 9) b(s) GROUP BY 1, 2),
i AS (SELECT vec_id, quantile_cont(q, 0.5) AS med FROM x WHERE k = 1 GROUP BY 1)
SELECT n.vec_id, round(max(p) FILTER (s = 2), 6) AS p_10, round(max(p) FILTER (s = 6), 6) AS p_30, CAST(min(s) FILTER (p >= 0.5) * 5 AS BIGINT) AS eta_min, round(any_value(med), 6) AS intensity FROM n JOIN i USING (vec_id) GROUP BY 1"""
)
def ensemble_products(spark: SparkSession, base: str) -> DataFrame:
    c = E.ensemble_products(cells(spark, base), members="members", n_steps=8, leads={10: 2, 30: 6}, threshold=0.5, step_min=5)
    return r6(c.select("vec_id", "p_10", "p_30", "eta_min", "intensity"), "p_10", "p_30", "intensity")


@query(
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS m FROM embeddings), o AS (SELECT vec_id, embedding[1]::DOUBLE AS y FROM embeddings),
a AS (SELECT x.vec_id, avg(abs(m - y)) AS near FROM x JOIN o USING (vec_id) GROUP BY 1), s AS (SELECT vec_id, m, row_number() OVER (PARTITION BY vec_id ORDER BY m) - 1 AS i FROM x),
b AS (SELECT vec_id, sum(m * (2 * i - 63)) / 4096.0 AS spread FROM s GROUP BY 1) SELECT e.label, count(*) AS n, round(avg(near - spread), 6) AS crps FROM a JOIN b USING (vec_id) JOIN embeddings e USING (vec_id) GROUP BY 1"""
)
def crps_by_label(spark: SparkSession, base: str) -> DataFrame:
    """CRPS of 64 members against the first as observation, by group."""
    e = table(spark, base, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.crps_ensemble(F.col("embedding"), F.get("embedding", F.lit(0)).cast("double"))), 6).alias("crps"))


@query(
    f"""WITH x AS (SELECT vec_id, embedding[1] AS y, list_slice(embedding, 2, 64) AS ms FROM embeddings),
k AS (SELECT vec_id, len(list_filter(ms, lambda z: z < y)) AS b, len(list_filter(ms, lambda z: z = y)) AS t FROM x)
SELECT CAST(b + floor((CAST('0x' || substr(md5('5|' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) * (t + 1)) AS INTEGER) AS rank, count(*) AS n FROM k GROUP BY 1"""
)
def rank_histogram(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    r = V.rank_of(F.expr("slice(embedding, 2, size(embedding))"), F.get("embedding", F.lit(0)), V.hash_draw(F.col("vec_id"), seed=5))
    return e.groupBy(r.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_C} SELECT CAST(row // 4 AS INTEGER) AS brow, CAST(col // 4 AS INTEGER) AS bcol, round(quantile_cont(v, 0.9), 6) AS v, count(v) AS n FROM g GROUP BY 1, 2")
def block_p90(spark: SparkSession, base: str) -> DataFrame:
    return r6(E.block_percentile(cells(spark, base), [], 4, "v"), "v")


@query(
    f"""WITH {_C}, p AS (SELECT a.row, a.col, sum(CASE WHEN b.v >= 0.5 THEN 1 ELSE 0 END) / 25.0 AS pf, sum(CASE WHEN b.u >= 0.5 THEN 1 ELSE 0 END) / 25.0 AS po FROM g a JOIN g b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2)
SELECT 1 AS grid, round(avg((pf - po) * (pf - po)), 6) AS mse, round(avg(pf * pf + po * po), 6) AS ref, round(1 - avg((pf - po) * (pf - po)) / avg(pf * pf + po * po), 6) AS fss FROM p"""
)
def fractions_skill(spark: SparkSession, base: str) -> DataFrame:
    g = cells(spark, base).withColumn("grid", F.lit(1))
    return r6(E.fractions_skill(g, ["grid"], F.col("v") >= 0.5, F.col("u") >= 0.5, 2), "mse", "ref", "fss")


@query(
    f"""WITH {_C}, z AS (SELECT vec_id AS id, row, col FROM c)
SELECT id, round(max(v), 6) AS v_max, round(avg(v), 6) AS v_mean, round(quantile_cont(v, 0.9), 6) AS v_p90, count(v) AS n FROM z JOIN (SELECT g.*, unnest(range(g.row - 3, g.row + 4)) AS near FROM g) g ON z.row = g.near AND (g.row - z.row) * (g.row - z.row) + (g.col - z.col) * (g.col - z.col) <= 9 GROUP BY 1"""
)
def disc_statistics(spark: SparkSession, base: str) -> DataFrame:
    g = cells(spark, base)
    return r6(E.disc_statistics(g.select("row", "col", "v"), g.select(F.col("vec_id").alias("id"), "row", "col"), 3, "v"), "v_max", "v_mean", "v_p90")


@query(
    f"""WITH {_C}, d AS (SELECT abs((lead(u) OVER r - lag(u) OVER r) / 2 + (lead(v) OVER k - lag(v) OVER k) / 2) AS d FROM g WINDOW r AS (PARTITION BY row ORDER BY col), k AS (PARTITION BY col ORDER BY row))
SELECT 1 AS grid, round(avg(d), 6) AS divergence, count(d) AS n FROM d"""
)
def motion_divergence(spark: SparkSession, base: str) -> DataFrame:
    return r6(E.divergence(cells(spark, base).withColumn("grid", F.lit(1)), ["grid"], "u", "v"), "divergence")


@query(
    f"""WITH {_C}, s AS (SELECT label, u, v FROM g WHERE v >= 0.2)
SELECT label, round(sum(v * u) / sum(v), 6) AS bulk, round(quantile_cont(u, 0.5), 6) AS robust, round(avg(CASE WHEN u < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS stalled_share, round(corr(u, v), 4) AS r FROM s GROUP BY 1"""
)
def bulk_motion(spark: SparkSession, base: str) -> DataFrame:
    """Rain-weighted and median motion, share of stalled cells and correlation over echo cells."""
    s = cells(spark, base).where("v >= 0.2")
    return s.groupBy("label").agg(F.round(F.sum(F.col("v") * F.col("u")) / F.sum("v"), 6).alias("bulk"), F.round(F.percentile("u", F.lit(0.5)), 6).alias("robust"), F.round(F.avg((F.col("u") < 0.5).cast("double")), 6).alias("stalled_share"), F.round(F.corr("u", "v"), 4).alias("r"))


@query(
    """WITH v AS (SELECT obs_id, CAST(value AS DOUBLE) AS x, observed_utc AS t, epoch_us(observed_utc) AS us FROM observations WHERE value IS NOT NULL AND NOT isnan(value))
SELECT obs_id, round(least(pow(pow(10, least(x, 53.0) / 10) / 200.0, 1 / 1.6), 100.0), 6) AS rate, round(CASE WHEN x > 0 THEN 10 * log10(200.0 * pow(x, 1.6)) END, 6) AS dbz, round(CASE WHEN x < 0.1 THEN -15.0 ELSE 10 * log10(x) END, 6) AS db,
 CAST(round_even((greatest(0.0, least(x, 25.4)) - 0.0) / 0.1, 0) AS INTEGER) AS q, us + ((-us) % 600000000 + 600000000) % 600000000 AS slot_us, CAST(round_even(us / 1e6 / 600.0, 0) AS BIGINT) * 600 AS slot_sec, floor(x / 5 + 0.5) * 5 AS to5,
 CASE WHEN month(t) BETWEEN 5 AND 9 THEN 'summer' WHEN month(t) IN (12, 1, 2, 3) THEN 'winter' ELSE 'shoulder' END AS season,
 CASE WHEN minute(t) % 10 = 0 THEN 'fullRange' WHEN minute(t) % 10 = 5 THEN 'doppler' ELSE 'unknown' END AS scan, (hour(t) * 60 + minute(t)) >= 1320 OR (hour(t) * 60 + minute(t)) < 360 AS quiet FROM v"""
)
def scalar_functions(spark: SparkSession, base: str) -> DataFrame:
    """The scalar library over all readings."""
    v = table(spark, base, "observations").where(V.finite(F.col("value"))).select("obs_id", F.col("value").cast("double").alias("x"), F.col("observed_utc").alias("t"))
    x, t, us = F.col("x"), F.col("t"), micros("t")
    return v.select(
        "obs_id", F.round(rain.rain_rate(x), 6).alias("rate"), F.round(rain.reflectivity(x), 6).alias("dbz"), F.round(rain.decibel(x), 6).alias("db"), rain.quantise(x, 0.1, 0.0).alias("q"), slot_end_us(us).alias("slot_us"),
        rounded_slot_sec(us / F.lit(1e6)).alias("slot_sec"), rain.round_to(x, 5.0).alias("to5"), convective_season(F.month(t)).alias("season"), rain.scan_type(F.minute(t)).alias("scan"), rain.in_quiet_hours(t, "UTC", 1320, 360).alias("quiet"),
    )


@query(
    """SELECT warning_id, CASE outcome WHEN 'hit' THEN 'hit' WHEN 'late' THEN 'late' WHEN 'false_alarm' THEN 'fa' ELSE 'unc' END || '-' || CASE WHEN length(trim(station_id)) < 5 THEN lpad(trim(station_id), 5, '0') ELSE trim(station_id) END || '-' || strftime(CAST(warned_at_utc AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y%m%dT%H%MZ') AS event_id
FROM warnings_scored WHERE station_id IS NOT NULL AND warned_at_utc IS NOT NULL"""
)
def event_ids(spark: SparkSession, base: str) -> DataFrame:
    short = F.when(F.col("outcome") == "hit", "hit").when(F.col("outcome") == "late", "late").when(F.col("outcome") == "false_alarm", "fa").otherwise("unc")
    stamp = F.date_format(F.to_utc_timestamp("warned_at_utc", F.current_timezone()), "yyyyMMdd'T'HHmm'Z'")
    return warnings(spark, base).select("warning_id", F.concat_ws("-", short, "station_id", stamp).alias("event_id"))


@query(
    f"""WITH {_WARN}, {_ST}, k AS (SELECT w.t_us // 21600000000 AS cell, st.lat, st.lon, (w.t_us % 21600000000) / 3.6e9 AS t FROM w JOIN st ON w.sid = st.station_id),
e AS (SELECT cell, count(*) AS n, regr_slope(lon, t) AS ve, regr_slope(lat, t) AS vn, avg(lat) AS clat, avg(lon) AS clon, stddev_pop(lat) AS spread FROM k GROUP BY 1 HAVING count(*) >= 5)
SELECT cell, n, round(ve, 4) AS ve, round(vn, 4) AS vn, round(clat, 6) AS clat, round(clon, 6) AS clon, round(spread, 6) AS spread FROM e"""
)
def cell_motion(spark: SparkSession, base: str) -> DataFrame:
    """Point events per six hours as a cell: least-squares motion, centre and spread."""
    k = warnings(spark, base).join(present(spark, base), "station_id").select(F.floor(F.col("t_us") / F.lit(21600 * MICROS)).alias("cell"), "lat", "lon", ((F.col("t_us") % F.lit(21600 * MICROS)) / F.lit(3.6e9)).alias("t"))
    e = k.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("lon", "t"), 4).alias("ve"), F.round(F.regr_slope("lat", "t"), 4).alias("vn"), F.round(F.avg("lat"), 6).alias("clat"), F.round(F.avg("lon"), 6).alias("clon"), F.round(F.stddev_pop("lat"), 6).alias("spread"))
    return e.where("n >= 5")


@query(
    """WITH k AS (SELECT station_id, observed_utc, parameter_id, count(*) AS n, count(DISTINCT value) AS nv FROM observations GROUP BY 1, 2, 3)
SELECT CASE WHEN n = 1 THEN 'single' WHEN nv <= 1 THEN 'same' ELSE 'corrected' END AS kind, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM k GROUP BY 1"""
)
def delivery_kinds(spark: SparkSession, base: str) -> DataFrame:
    k = table(spark, base, "observations").groupBy("station_id", "observed_utc", "parameter_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("corrected")
    return k.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


@query(
    """SELECT station_id, epoch_us(observed_utc) AS us, parameter_id, obs_id FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc, parameter_id ORDER BY coalesce(created_utc, observed_utc) DESC, obs_id DESC) AS k FROM observations) WHERE k = 1"""
)
def keyed_upsert(spark: SparkSession, base: str) -> DataFrame:
    """The corrections of all readings written over their first deliveries: old rows by anti-join on the natural key, new rows by name."""
    key = ["station_id", "observed_utc", "parameter_id"]
    at = F.struct(F.coalesce("created_utc", "observed_utc").alias("at"), "obs_id")
    d = table(spark, base, "observations").groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    old = d.select(*key, F.col("first.obs_id").alias("obs_id"))
    new = d.where("last.obs_id <> first.obs_id").select(*key, F.col("last.obs_id").alias("obs_id"))
    return store.upsert(old, new, key).select("station_id", micros("observed_utc").alias("us"), "parameter_id", "obs_id")


@query(
    """WITH k AS (SELECT parameter_id, CASE WHEN value IS NULL THEN 'no value' WHEN created_utc IS NULL THEN 'ok, no created' ELSE 'ok' END AS reason FROM observations)
SELECT parameter_id, reason, count(*) AS n FROM k GROUP BY 1, 2"""
)
def parsed_features(spark: SparkSession, base: str) -> DataFrame:
    """Readings written as GeoJSON features and parsed back, counted by reason."""
    o = table(spark, base, "observations")
    parsed = geojson.parse_observations(geojson.write_observations(o))
    return parsed.groupBy("parameter_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT doc_id, unnest(cells) AS c FROM documents), k AS (SELECT doc_id, c.cell_type AS t, c.execution_count AS x, c.char_to - c.char_from AS len FROM c)
SELECT t AS cell_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(sum(len) AS BIGINT) AS chars, count(x) AS n_run, round(avg(len), 6) AS mean_len FROM k GROUP BY 1"""
)
def nested_cells(spark: SparkSession, base: str) -> DataFrame:
    """Nested records unfolded and counted by kind."""
    k = table(spark, base, "documents").select("doc_id", F.explode("cells").alias("c")).select("doc_id", F.col("c.cell_type").alias("cell_type"), F.col("c.execution_count").alias("x"), (F.col("c.char_to") - F.col("c.char_from")).alias("len"))
    return k.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum("len").alias("chars"), F.count("x").alias("n_run"), F.round(F.avg("len"), 6).alias("mean_len"))


@query(
    """WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT CASE WHEN grouping(source) = 0 AND grouping(lang) = 0 THEN 'both' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS level, source, lang, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())"""
)
def facet_counts(spark: SparkSession, base: str) -> DataFrame:
    """Counts by each facet, their combination and in all, in one pass."""
    g = table(spark, base, "documents").cube("source", "lang").agg(F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"), F.count(F.lit(1)).alias("n"))
    level = F.when((F.col("gs") == 0) & (F.col("gl") == 0), "both").when(F.col("gs") == 0, "source").when(F.col("gl") == 0, "lang").otherwise("all")
    return g.select(level.alias("level"), "source", "lang", "n")


@query(
    """WITH r AS (SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS q, sum(l_extendedprice * (1 - l_discount)) AS rev, avg(l_discount) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(q, 2) AS sum_qty, round(rev, 2) AS revenue, round(d, 6) AS avg_disc, n FROM r"""
)
def pricing_summary(spark: SparkSession, base: str) -> DataFrame:
    """A plain pushed-down scan and aggregate, as a yardstick of the session."""
    l = table(spark, base, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
