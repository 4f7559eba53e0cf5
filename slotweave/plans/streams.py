"""Streaming queries, run to the end of the given files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import micros
from slotweave.plans.gauges import _WARN, warnings
from slotweave.plans.scoring import decisions, replay_sql
from slotweave.runtime import table
from slotweave.streaming import pipelines as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def arrival():
    return F.coalesce(micros("created_utc"), micros("observed_utc"))


@query(
    """SELECT station_id, parameter_id, epoch_us(date_trunc('hour', observed_utc)) AS hour_us, count(*) AS n, count(value) AS n_known, round(sum(CAST(value AS DOUBLE)), 3) AS total FROM observations
WHERE coalesce(created_utc, observed_utc) <= date_trunc('hour', observed_utc) + INTERVAL 25 HOUR GROUP BY 1, 2, 3"""
)
def stream_slot_counts(spark: SparkSession, base: str) -> DataFrame:
    """Hourly counts as last published: readings come in order of arrival, in four batches."""
    return P.latest(P.feed(table(spark, base, "observations"), arrival(), P.slot_counts, mode="update"), ["station_id", "parameter_id", "hour_us"])


@query("""WITH w AS (SELECT station_id, epoch_us(warned_at_utc) // 600000000 * 600000000 - i * 600000000 AS from_us FROM warnings_scored, range(3) t(i) WHERE warned_at_utc IS NOT NULL) SELECT station_id, CAST(from_us AS BIGINT) AS from_us, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding_counts(spark: SparkSession, base: str) -> DataFrame:
    return P.latest(P.feed(table(spark, base, "warnings_scored"), micros("warned_at_utc"), P.sliding_counts, mode="update"), ["station_id", "from_us"])


@query(
    """SELECT station_id, parameter_id, epoch_us(observed_utc) AS us, obs_id, round(CAST(value AS DOUBLE), 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc, parameter_id ORDER BY coalesce(created_utc, observed_utc) DESC, obs_id DESC) AS k FROM observations) WHERE k = 1"""
)
def stream_deduplicated(spark: SparkSession, base: str) -> DataFrame:
    """The observation store kept by a stream: every batch is merged into the days it touches, the last delivery of a key wins."""
    path = P.scratch(spark) + "/store"
    sink = P.last_deliveries(path, ["station_id", "observed_utc", "parameter_id"], [arrival(), F.col("obs_id")], "day")
    P.feed(table(spark, base, "observations"), arrival(), lambda s: s.withColumn("day", F.to_date("observed_utc")), sink=sink)
    return spark.read.parquet(path).select("station_id", "parameter_id", micros("observed_utc").alias("us"), "obs_id", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"WITH RECURSIVE {_WARN}, {replay_sql([60], gap_us=10**17)} SELECT station_id, row_id, us, action FROM st WHERE k > 0 AND action <> 'none'")
def stream_decisions(spark: SparkSession, base: str) -> DataFrame:
    """The notification rule as keyed state over the stream of warnings."""
    return P.feed(decisions(spark, base), F.col("us"), lambda d: P.decide(d, 60)).drop("batch")


@query(
    """WITH r AS (SELECT station_id, observed_utc, epoch_us(date_trunc('hour', observed_utc)) AS pane_us, CAST(round(greatest(CAST(value AS DOUBLE), 0) * 10) AS BIGINT) AS a, coalesce(created_utc, observed_utc) AS arr, obs_id FROM observations WHERE parameter_id = 'precip_past10min' AND value IS NOT NULL AND NOT isnan(value)),
k AS (SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc ORDER BY arr DESC, obs_id DESC) AS i FROM r WHERE epoch_us(arr) <= pane_us + 90000000000)
SELECT station_id, pane_us, count(*) AS n, CAST(sum(a) AS BIGINT) AS amount FROM k WHERE i = 1 GROUP BY 1, 2"""
)
def stream_live_panes(spark: SparkSession, base: str) -> DataFrame:
    """The last emission of every pane; readings come in order of arrival, in four batches."""
    e = P.latest(P.feed(table(spark, base, "observations"), arrival(), P.live_panes), ["station_id", "pane_us"])
    return e.select("station_id", "pane_us", "n", "amount")


@query(
    """WITH w AS (SELECT *, CASE WHEN length(trim(station_id)) < 5 THEN lpad(trim(station_id), 5, '0') ELSE trim(station_id) END AS sid, epoch_us(warned_at_utc) AS t_us FROM warnings_scored WHERE station_id IS NOT NULL AND warned_at_utc IS NOT NULL),
d AS (SELECT sid AS station_id, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY sid ORDER BY t_us) >= 7200000000 THEN 1 ELSE 0 END AS nw FROM w),
r AS (SELECT *, sum(nw) OVER (PARTITION BY station_id ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d)
SELECT station_id, min(t_us) AS from_us, max(t_us) + 7200000000 AS to_us, count(*) AS n FROM r GROUP BY station_id, run"""
)
def session_windows(spark: SparkSession, base: str) -> DataFrame:
    """Sessions by Spark's own session windows."""
    g = warnings(spark, base).groupBy("station_id", F.session_window("warned_at_utc", "2 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("station_id", micros(F.col("s.start")).alias("from_us"), micros(F.col("s.end")).alias("to_us"), "n")
