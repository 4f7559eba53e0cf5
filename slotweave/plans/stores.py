"""Queries of stored tables: windowed reads, backfills, unions of directories, wide and long forms, retention, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import micros
from slotweave.operators import verification as V
from slotweave.plans.gauges import _WARN, warnings
from slotweave.plans.reports import corpus
from slotweave.runtime import table
from slotweave.sources import store
from slotweave.streaming.pipelines import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ["station_id", "observed_utc", "parameter_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def arrived():
    return [F.coalesce("created_utc", "observed_utc"), F.col("obs_id")]


def observation_store(spark: SparkSession, base: str) -> str:
    """The observations as a store partitioned by day, the last delivery of each key; the folder."""
    path = scratch(spark) + "/observations"
    o = table(spark, base, "observations").where("station_id is not null and observed_utc is not null").withColumn("day", F.to_date("observed_utc"))
    store.append_idempotent(spark, path, o, KEY, arrived(), "day")
    return path


_LAST = "la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc, parameter_id ORDER BY coalesce(created_utc, observed_utc) DESC, obs_id DESC) AS k FROM observations WHERE station_id IS NOT NULL AND observed_utc IS NOT NULL) WHERE k = 1)"


@query(
    f"""WITH {_LAST} SELECT station_id, epoch_us(observed_utc) AS us, parameter_id, obs_id FROM la WHERE observed_utc BETWEEN TIMESTAMPTZ '2026-08-30 06:00:00+00' AND TIMESTAMPTZ '2026-08-31 18:00:00+00' AND parameter_id IN ('precip_past10min', 'temp_dry') ORDER BY 1, 2, 3"""
)
def store_window(spark: SparkSession, base: str) -> DataFrame:
    """A window of the store with its parameters, in order: days are pruned, the rest is pushed down."""
    w = store.read_window(spark, observation_store(spark, base), "2026-08-30T06:00:00Z", "2026-08-31T18:00:00Z", parameters=["precip_past10min", "temp_dry"])
    return w.select("station_id", micros("observed_utc").alias("us"), "parameter_id", "obs_id").orderBy("station_id", "us", "parameter_id")


@query(f"""WITH {_LAST} SELECT epoch_us(date_trunc('day', observed_utc)) AS first_us, epoch_us(date_trunc('day', observed_utc)) + 86400000000 AS last_us, count(*) AS n FROM la GROUP BY 1, 2""")
def store_spans(spark: SparkSession, base: str) -> DataFrame:
    """What each partition of the store can hold, by its path, and what it holds."""
    return store.partition_spans(spark, observation_store(spark, base))


@query(
    """WITH f AS (SELECT station_id, observed_utc, parameter_id, arg_min(obs_id, (coalesce(created_utc, observed_utc), obs_id)) AS a, arg_max(obs_id, (coalesce(created_utc, observed_utc), obs_id)) AS b, count(*) AS n FROM observations GROUP BY 1, 2, 3)
SELECT strftime(CAST(observed_utc AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m') AS month, count(*) AS n, CAST(sum(CASE WHEN n > 1 THEN b ELSE a END) AS BIGINT) AS id_sum, count(*) FILTER (a <> b) AS replaced FROM f GROUP BY 1"""
)
def backfilled_months(spark: SparkSession, base: str) -> DataFrame:
    """Months of first deliveries with the repeated keys' last deliveries put over them, summed up per month."""
    at = F.struct(F.coalesce("created_utc", "observed_utc").alias("at"), "obs_id")
    d = table(spark, base, "observations").groupBy(*KEY).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n"))
    month = d.select(*KEY, F.col("a.obs_id").alias("obs_id"), F.lit(0).alias("new"))
    days = d.where("n > 1").select(*KEY, F.col("b.obs_id").alias("obs_id"), (F.col("a.obs_id") != F.col("b.obs_id")).cast("int").alias("new"))
    m = store.month_rows(month, days, KEY)
    return m.groupBy(F.date_format("observed_utc", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("obs_id").alias("id_sum"), F.sum("new").alias("replaced"))


@query(
    f"""WITH {_WARN}, t AS (SELECT 0 AS dir, sid AS station_id, t_us, warning_id, p_rain AS p_rain_30, NULL::DOUBLE AS p_rain_10, NULL::DOUBLE AS eta_min FROM w UNION ALL SELECT 1, sid, t_us, warning_id, NULL, p_rain, eta_min FROM w WHERE eta_min IS NOT NULL)
SELECT station_id, t_us, warning_id, round(p_rain_30, 6) AS p_rain_30, round(p_rain_10, 6) AS p_rain_10, round(eta_min, 6) AS eta_min FROM t QUALIFY row_number() OVER (PARTITION BY station_id, t_us ORDER BY dir DESC, warning_id DESC) = 1"""
)
def united_decisions(spark: SparkSession, base: str) -> DataFrame:
    """Two sets of decisions with different columns as one: missing columns null, of a key the last set's row, the last id."""
    w = warnings(spark, base)
    a = w.select("station_id", "t_us", "warning_id", F.col("p_rain").alias("p_rain_30"))
    b = w.where("eta_min is not null").select("station_id", "t_us", "warning_id", F.col("p_rain").alias("p_rain_10"), "eta_min")
    u = store.last_table_wins([a, b], ["station_id", "t_us"], [F.col("warning_id")])
    return u.withColumns({c: F.round(c, 6) for c in ("p_rain_30", "p_rain_10", "eta_min")})


@query(
    """WITH c AS (SELECT event_time, point_id, lead_min, max(CAST(raw_prob AS DOUBLE)) AS p FROM calibration_corpus WHERE isfinite(raw_prob) GROUP BY 1, 2, 3)
SELECT event_time, point_id, round(max(p) FILTER (lead_min = 10), 6) AS p_rain_10, round(max(p) FILTER (lead_min = 30), 6) AS p_rain_30, round(max(p) FILTER (lead_min = 60), 6) AS p_rain_60 FROM c GROUP BY 1, 2"""
)
def wide_forecasts(spark: SparkSession, base: str) -> DataFrame:
    """One row per event and point with a column per lead."""
    c = corpus(spark, base).where(V.finite(F.col("raw_prob"))).withColumn("p", F.col("raw_prob").cast("double"))
    w = store.to_wide(c, ["event_time", "point_id"], "lead_min", "p", [10, 30, 60])
    return w.withColumns({x: F.round(x, 6) for x in store.lead_columns(w.columns).values()})


@query("""SELECT event_time, point_id, lead_min, round(max(CAST(raw_prob AS DOUBLE)), 6) AS p FROM calibration_corpus WHERE isfinite(raw_prob) AND lead_min IN (10, 30, 60) GROUP BY 1, 2, 3""")
def long_forecasts(spark: SparkSession, base: str) -> DataFrame:
    """The wide form back in rows, leads by the columns' names."""
    return store.to_long(wide_forecasts(spark, base), ["event_time", "point_id"], "lead_min", "p")


@query(
    f"""WITH {_LAST}, k AS (SELECT *, date_trunc('day', observed_utc) AS day FROM la), m AS (SELECT max(day) AS top FROM k) SELECT epoch_us(day) AS day_us, count(*) AS n FROM k, m WHERE day > top - INTERVAL 7 DAY GROUP BY 1"""
)
def retained_days(spark: SparkSession, base: str) -> DataFrame:
    """The store's last seven days: older partitions are dropped by their names."""
    t = spark.read.parquet(observation_store(spark, base))
    top = t.agg(F.max("day").alias("top"))  # one row, from the partitions' names
    k = t.join(F.broadcast(top)).where(F.col("day") > F.date_sub("top", 7))
    return k.groupBy(F.unix_micros(F.col("day").cast("timestamp")).alias("day_us")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT event_time FROM calibration_corpus ORDER BY event_time DESC LIMIT 48), p AS (SELECT min(event_time) AS event_time FROM calibration_corpus)
SELECT event_time, count(*) AS n FROM calibration_corpus WHERE event_time IN (SELECT event_time FROM t) OR event_time IN (SELECT event_time FROM p) GROUP BY 1"""
)
def newest_cycles(spark: SparkSession, base: str) -> DataFrame:
    """The forty-eight newest cycles and the protected first one."""
    c = corpus(spark, base)
    first = c.agg(F.min("event_time")).first()[0]
    return store.newest(c, "event_time", 48, [first] if first else []).groupBy("event_time").agg(F.count(F.lit(1)).alias("n"))


_TAGS = ("precip_past10min", "temp_dry", "pressure", "wind_speed")


@query(
    f"""SELECT station_id, coalesce(array_to_string(parameter_ids, '|'), '') AS tags, operation_to IS NULL AS present, {", ".join(f"coalesce(list_contains(parameter_ids, '{t}'), false) AS tag_{t}" for t in _TAGS)} FROM station_catalogue"""
)
def exported_catalogue(spark: SparkSession, base: str) -> DataFrame:
    """The catalogue with a switch per parameter and joined tags, written as CSV and read back."""
    c = store.with_flags(table(spark, base, "station_catalogue"), "parameter_ids", _TAGS)
    c = c.select("station_id", F.coalesce(F.array_join("parameter_ids", "|"), F.lit("")).alias("tags"), F.col("operation_to").isNull().alias("present"), *[f"tag_{t}" for t in _TAGS])
    path = scratch(spark) + "/catalogue"
    c.write.option("header", True).option("emptyValue", "").csv(path)
    return spark.read.schema(c.schema).option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path).withColumn("tags", F.coalesce("tags", F.lit("")))
