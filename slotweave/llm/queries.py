"""Registered queries of problems 4, 7, 8, 9 and 10 and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions.text import station_number
from slotweave.functions.timeexpr import DAY_US, floor_us, iso_utc_us, micros
from slotweave.llm import bpe, mixture, nearest, sketch, toxicity
from slotweave.operators.blocks import block_of, running_sums
from slotweave.runtime import cut, table

TOLERANCE_S, FIRST_RING_S = 15 * 60, 5 * 60
ACCURACY = 0.01
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
FRACTIONS = (0.25, 1.0)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Each warning with the nearest rain reading of its station within 15 minutes."""
    obs = table(spark, base, "observations").where("parameter_id = 'precip_past10min' and value is not null and not isnan(value)")
    pairs = nearest.nearest(
        table(spark, base, "warnings_scored"), obs, left_id="warning_id", left_entity=nearest.entity_key(F.col("station_id")), left_time="warned_at_utc",
        right_id="obs_id", right_entity=nearest.entity_key(F.col("station_id")), right_time="observed_utc", tolerance_s=TOLERANCE_S, first_ring_s=FIRST_RING_S,
    )
    return pairs.select(F.col("left_id").alias("warning_id"), F.col("right_id").alias("obs_id")).distinct()


def warning_sketch(spark: SparkSession, base: str) -> DataFrame:
    """Sketches of separate days: one per station and day."""
    w = table(spark, base, "warnings_scored").withColumn("station", nearest.entity_key(F.col("station_id")))
    w = w.withColumn("day_us", floor_us(micros("warned_at_utc"), DAY_US))
    return sketch.sketch(w, groups=["station", "day_us"], values=["lead_error_min", "eta_min"], accuracy=ACCURACY)


def p7_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles per station, from the sketches of its days combined; a null station is a group of its own."""
    merged = sketch.merge(warning_sketch(spark, base), groups=["station"])
    p = sketch.percentiles(merged, groups=["station"], probabilities=PROBABILITIES, accuracy=ACCURACY)
    return p.select(station_number(F.col("station")).alias("station_id"), "metric", "n", *[sketch.significant(F.col(c)).alias(c) for c in p.columns[3:]])


def p7_checked(spark: SparkSession, base: str) -> DataFrame:
    """Every percentile beside the exact value at its rank, and whether it keeps the bound (the SQL twin states the exact value, and that it must)."""
    w = table(spark, base, "warnings_scored").withColumn("station", nearest.entity_key(F.col("station_id")))
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in ("lead_error_min", "eta_min")]))
    d = w.select("station", pairs.alias("p")).select("station", "p.*").where("x is not null and not isnan(x) and abs(x) < double('infinity')").groupBy("station", "metric", "x").agg(F.count(F.lit(1)).alias("k"))
    r = running_sums(d, ["station", "metric"], [F.col("x")], block_of(F.col("x"), 4.0), {"to": F.col("k")})
    p = sketch.percentiles(sketch.merge(warning_sketch(spark, base), groups=["station"]), groups=["station"], probabilities=PROBABILITIES, accuracy=ACCURACY)
    long = F.explode(F.array(*[F.struct(F.lit(q).alias("probability"), F.col(c).alias("about")) for q, c in zip(PROBABILITIES, p.columns[3:])]))
    p = p.select(F.col("station").alias("s"), F.col("metric").alias("m"), "n", long.alias("q")).select("s", "m", "n", "q.*")
    j = p.join(r, F.col("s").eqNullSafe(F.col("station")) & (F.col("m") == F.col("metric"))).where(F.col("to") > F.floor(F.col("probability") * (F.col("n") - 1)))
    e = j.groupBy("s", "m", "n", "probability", "about").agg(F.min("x").alias("exact"))
    within = F.abs(F.col("about") - F.col("exact")) <= ACCURACY * F.abs(F.col("exact")) * (1 + 1e-9)
    return e.select(station_number(F.col("s")).alias("station_id"), F.col("m").alias("metric"), "n", "probability", "exact", within.alias("within"))


def p7_daily_sketch(spark: SparkSession, base: str) -> DataFrame:
    return warning_sketch(spark, base).select(station_number(F.col("station")).alias("station_id"), iso_utc_us(F.col("day_us")).alias("day_utc"), "metric", "bucket", "n")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode(table(spark, base, "documents"))


def document_sizes(spark: SparkSession, base: str) -> DataFrame:
    """``doc_id, source, size, h``: tokens of every document, counted once and written out."""
    n = bpe.count_tokens(table(spark, base, "documents"), keep=["doc_id", "source"], name="size")
    return cut(n.withColumn("h", mixture.hash_of("doc_id")))


def p9_mixture(spark: SparkSession, base: str) -> DataFrame:
    """The documents of each budget with their number of copies."""
    chosen, _ = mixture.mix(document_sizes(spark, base), table(spark, base, "source_targets"), fractions=FRACTIONS)
    return chosen.select("fraction", "doc_id", "source", F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """Target and reached shares of each source."""
    _, shares = mixture.mix(document_sizes(spark, base), table(spark, base, "source_targets"), fractions=FRACTIONS)
    return shares.select("fraction", "source", F.round("target_share", 9).alias("target_share"), F.col("want").cast("long").alias("want"), F.col("got").cast("long").alias("got"), F.round("share", 9).alias("share"), "repeats")


def p10_scores(spark: SparkSession, base: str) -> DataFrame:
    """Every document with its score and verdict."""
    docs = table(spark, base, "documents")
    model = toxicity.fit(docs, table(spark, base, "doc_labels"))
    return toxicity.score(docs, model, keep=["doc_id", "source"])


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return p10_scores(spark, base).where("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    """Flagged documents per source; documents without source are a group of their own."""
    s = p10_scores(spark, base).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("flagged").alias("n_flagged"))
    return s.withColumn("rate", F.round(F.col("n_flagged") / F.col("n_docs"), 9))


QUERIES = {f.__name__: f for f in (p4_found, p7_percentiles, p7_daily_sketch, p7_checked, p8_ids, p9_mixture, p9_shares, p10_scores, p10_found, p10_rates)}

_KEY = "nullif(regexp_replace(trim(station_id), '^0+(.)', '\\1'), '')"
_PAD = "CASE WHEN length(station) < 5 THEN lpad(station, 5, '0') ELSE station END"
_G = "ln((1 + 0.01) / (1 - 0.01))"
_BUCKETS = f"""
v AS (SELECT {_KEY} AS station, CAST(floor(epoch_us(warned_at_utc) / 86400000000.0) AS BIGINT) AS day, 'lead_error_min' AS metric, lead_error_min AS x FROM warnings_scored
      UNION ALL SELECT {_KEY}, CAST(floor(epoch_us(warned_at_utc) / 86400000000.0) AS BIGINT), 'eta_min', eta_min FROM warnings_scored),
b AS (SELECT station, day, metric, CASE WHEN x = 0 THEN 0 WHEN x > 0 THEN k ELSE -k END AS bucket FROM (
        SELECT *, CASE WHEN x = 0 THEN 0 ELSE CAST(ceil(round(ln(abs(x)) / {_G}, 9)) AS BIGINT) + 1048576 END AS k FROM v WHERE x IS NOT NULL AND isfinite(x)))"""
_G2 = "((1 + 0.01) / (1 - 0.01))"
ORACLES = {
    "p4_found": f"""
WITH w AS (SELECT warning_id, {_KEY} AS s, warned_at_utc AS t FROM warnings_scored WHERE warned_at_utc IS NOT NULL),
o AS (SELECT obs_id, {_KEY} AS s, observed_utc AS t FROM observations WHERE parameter_id = 'precip_past10min' AND value IS NOT NULL AND NOT isnan(value))
SELECT warning_id, obs_id FROM (
  SELECT warning_id, obs_id, row_number() OVER (PARTITION BY warning_id ORDER BY abs(epoch_us(o.t) - epoch_us(w.t)), o.t, obs_id) AS k
  FROM w JOIN o ON w.s = o.s AND o.t >= w.t - INTERVAL 15 MINUTE AND o.t <= w.t + INTERVAL 15 MINUTE) WHERE k = 1
""",
    "p7_percentiles": f"""
WITH {_BUCKETS},
r AS (SELECT station, metric, bucket, row_number() OVER (PARTITION BY station, metric ORDER BY bucket) - 1 AS i, count(*) OVER (PARTITION BY station, metric) AS n FROM b),
p AS (SELECT station, metric, n, {", ".join(f"max(bucket) FILTER (i = CAST(floor({p} * (n - 1)) AS BIGINT)) AS q{j}" for j, p in enumerate(PROBABILITIES))} FROM r GROUP BY 1, 2, 3)
SELECT {_PAD} AS station_id, metric, n, {", ".join(f"CAST(printf('%.8e', CASE WHEN q{j} = 0 THEN 0.0 ELSE sign(q{j}) * pow({_G2}, CAST(abs(q{j}) - 1048576 AS DOUBLE)) * 2.0 / (1 + {_G2}) END) AS DOUBLE) AS p{p * 100:g}" for j, p in enumerate(PROBABILITIES))}
FROM p
""",
    "p7_daily_sketch": f"""
WITH {_BUCKETS}
SELECT {_PAD} AS station_id, strftime(make_timestamp(day * 86400000000), '%Y-%m-%dT%H:%M:%SZ') AS day_utc, metric, bucket, count(*) AS n FROM b GROUP BY ALL
""",
    "p7_checked": f"""
WITH {_BUCKETS},
x AS (SELECT station, metric, x, row_number() OVER (PARTITION BY station, metric ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY station, metric) AS n FROM v WHERE x IS NOT NULL AND isfinite(x))
SELECT {_PAD} AS station_id, metric, n, probability, x AS exact, true AS within FROM x JOIN (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PROBABILITIES)}]) AS probability) q ON i = CAST(floor(probability * (n - 1)) AS BIGINT)
""",
}
