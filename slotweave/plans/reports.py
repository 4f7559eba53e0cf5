"""Calibration reports over the forecast corpus, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import meteorological_season
from slotweave.operators import verification as V
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


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def month(c: Column) -> Column:
    return F.substring(c, 6, 2).cast("int")


def corpus(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "calibration_corpus")


def valid(spark: SparkSession, base: str) -> DataFrame:
    return V.valid_forecasts(corpus(spark, base))


_V = """v AS (SELECT *, CAST(raw_prob AS DOUBLE) AS p, CAST(outcome AS DOUBLE) AS y, sample_weight AS w FROM calibration_corpus
  WHERE isfinite(raw_prob) AND outcome IS NOT NULL AND isfinite(sample_weight) AND sample_weight > 0),
b AS (SELECT *, greatest(0, least(CAST(floor(p * 10) AS INTEGER), 9)) AS bin, CAST(substr(event_time, 6, 2) AS INTEGER) AS mon FROM v)"""
_REL = "count(*) AS n, round(sum(w), 6) AS sum_w, round(sum(w) * sum(w) / sum(w * w), 6) AS eff_n, round(sum(w * p) / sum(w), 6) AS mean_p, round(sum(w * y) / sum(w), 6) AS freq, round(avg(y), 6) AS freq_plain"
_RELC = ("sum_w", "eff_n", "mean_p", "freq", "freq_plain")
_SEASON = "CASE WHEN mon IN (12, 1, 2) THEN 'DJF' WHEN mon IN (3, 4, 5) THEN 'MAM' WHEN mon IN (6, 7, 8) THEN 'JJA' WHEN mon IN (9, 10, 11) THEN 'SON' END"


@query(f"WITH {_V} SELECT lead_min, bin, {_REL} FROM b GROUP BY 1, 2")
def reliability_pooled(spark: SparkSession, base: str) -> DataFrame:
    return r6(V.reliability(valid(spark, base), ["lead_min"]), *_RELC)


@query(f"WITH {_V} SELECT region, lead_min, bin, {_REL} FROM b GROUP BY 1, 2, 3")
def reliability_by_region(spark: SparkSession, base: str) -> DataFrame:
    return r6(V.reliability(valid(spark, base), ["region", "lead_min"]), *_RELC)


@query(f"WITH {_V} SELECT {_SEASON} AS season, lead_min, bin, {_REL} FROM b GROUP BY 1, 2, 3")
def reliability_by_season(spark: SparkSession, base: str) -> DataFrame:
    v = valid(spark, base).withColumn("season", meteorological_season(month(F.col("event_time"))))
    return r6(V.reliability(v, ["season", "lead_min"]), *_RELC)


@query(f"WITH {_V} SELECT point_set, lead_min, bin, {_REL} FROM b WHERE point_set = 'gauge' GROUP BY 1, 2, 3")
def reliability_point_set(spark: SparkSession, base: str) -> DataFrame:
    return r6(V.reliability(valid(spark, base).where("point_set = 'gauge'"), ["point_set", "lead_min"]), *_RELC)


@query(
    f"WITH {_V}, l AS (SELECT DISTINCT lead_min FROM b), g AS (SELECT lead_min, CAST(i AS INTEGER) AS bin FROM l, range(10) t(i)), a AS (SELECT lead_min, bin, {_REL} FROM b GROUP BY 1, 2) "
    "SELECT lead_min, bin, coalesce(n, 0) AS n, coalesce(sum_w, 0.0) AS sum_w, eff_n, mean_p, freq, freq_plain FROM g LEFT JOIN a USING (lead_min, bin)"
)
def reliability_with_empty_bins(spark: SparkSession, base: str) -> DataFrame:
    return r6(V.reliability_all_bins(valid(spark, base), ["lead_min"]), *_RELC)


@query(
    f"""WITH {_V},
bs AS (SELECT lead_min, bin, count(*) AS n, sum(w) AS sw, sum(w * p) / sum(w) AS mp, sum(w * y) / sum(w) AS my, sum(w * (p - y) * (p - y)) AS se FROM b GROUP BY 1, 2),
ls AS (SELECT lead_min, count(*) AS n, sum(w) AS tw, sum(w * y) / sum(w) AS base, sum(w * (p - y) * (p - y)) / sum(w) AS brier FROM b GROUP BY 1),
d AS (SELECT lead_min, ls.n, base, brier, sum(sw / tw * (mp - my) * (mp - my)) AS rel, sum(sw / tw * (my - base) * (my - base)) AS res FROM bs JOIN ls USING (lead_min) GROUP BY 1, 2, 3, 4)
SELECT lead_min, n, round(base, 6) AS base_rate, round(brier, 6) AS brier, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(base * (1 - base), 6) AS uncertainty,
       round(brier - (rel - res + base * (1 - base)), 6) + 0.0 AS residual, round(1 - brier / nullif(base * (1 - base), 0), 6) AS bss FROM d"""
)
def brier_decomposition(spark: SparkSession, base: str) -> DataFrame:
    m = r6(V.murphy(valid(spark, base), ["lead_min"]), "base_rate", "brier", "reliability", "resolution", "uncertainty", "residual", "bss")
    return m.withColumn("residual", F.col("residual") + 0.0)


_BANDS = "CASE WHEN cov <= 0 THEN '0 none' WHEN cov < 0.1 THEN '1 light' WHEN cov < 0.25 THEN '2 scattered' WHEN cov < 0.5 THEN '3 broad' ELSE '4 general' END"


@query(
    f"""WITH {_V}, v1 AS (SELECT * FROM b WHERE lead_min = (SELECT min(lead_min) FROM b)),
e AS (SELECT event_time, sum(w * y) / sum(w) AS cov FROM v1 GROUP BY 1), k AS (SELECT event_time, {_BANDS} AS band FROM e)
SELECT band, b.lead_min, count(DISTINCT event_time) AS n_events, count(*) AS n, round(sum(w * y) / sum(w), 6) AS base_rate, round(sum(w * p) / sum(w), 6) AS mean_p FROM b JOIN k USING (event_time) GROUP BY 1, 2"""
)
def base_rate_by_intensity(spark: SparkSession, base: str) -> DataFrame:
    v = valid(spark, base)
    least = v.agg(F.min("lead_min").alias("m"))
    first = v.join(F.broadcast(least), F.col("lead_min") == F.col("m"), "left_semi")  # one row
    cov = first.groupBy("event_time").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("cov"))
    c = F.col("cov")
    band = F.when(c <= 0, "0 none").when(c < 0.1, "1 light").when(c < 0.25, "2 scattered").when(c < 0.5, "3 broad").otherwise("4 general")
    j = v.join(cov.select("event_time", band.alias("band")), "event_time")
    out = j.groupBy("band", "lead_min").agg(F.countDistinct("event_time").alias("n_events"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("base_rate"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("mean_p"))
    return r6(out, "base_rate", "mean_p")


@query(
    f"""WITH {_V}, s AS (SELECT *, {_SEASON} AS season FROM b)
SELECT 'pooled' AS stratum, CAST(NULL AS VARCHAR) AS key, lead_min, count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 6) AS eff_n, round(sum(w) * sum(w) / sum(w * w) / count(*), 6) AS ratio FROM s GROUP BY 3
UNION ALL SELECT 'region', region, lead_min, count(*), round(sum(w) * sum(w) / sum(w * w), 6), round(sum(w) * sum(w) / sum(w * w) / count(*), 6) FROM s GROUP BY 2, 3
UNION ALL SELECT 'season', season, lead_min, count(*), round(sum(w) * sum(w) / sum(w * w), 6), round(sum(w) * sum(w) / sum(w * w) / count(*), 6) FROM s GROUP BY 2, 3"""
)
def effective_n_by_stratum(spark: SparkSession, base: str) -> DataFrame:
    """One scan with grouping sets instead of a union of three aggregations."""
    v = valid(spark, base).withColumn("season", meteorological_season(month(F.col("event_time"))))
    g = v.groupingSets([["lead_min"], ["lead_min", "region"], ["lead_min", "season"]], "lead_min", "region", "season").agg(F.grouping("region").alias("gr"), F.grouping("season").alias("gs"), F.count(F.lit(1)).alias("n"), V.kish(F.col("w")).alias("eff_n"))
    out = g.select(
        F.when(F.col("gr") == 0, "region").when(F.col("gs") == 0, "season").otherwise("pooled").alias("stratum"),
        F.when(F.col("gr") == 0, F.col("region")).when(F.col("gs") == 0, F.col("season")).alias("key"), "lead_min", "n", "eff_n", (F.col("eff_n") / F.col("n")).alias("ratio"),
    )
    return r6(out, "eff_n", "ratio")


@query(
    f"""WITH {_V}, po AS (SELECT lead_min, bin, sum(w * y) / sum(w) AS f FROM b GROUP BY 1, 2),
rg AS (SELECT region, lead_min, bin, sum(w * y) / sum(w) AS rf, sum(w) * sum(w) / sum(w * w) AS en FROM b WHERE region IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT region, lead_min, count(*) FILTER (WHERE abs(rf - f) > 2 * sqrt(greatest(f, 1e-6) * (1 - least(f, 1 - 1e-6)) / en)) AS k, count(*) AS bins FROM rg JOIN po USING (lead_min, bin) WHERE en >= 20 GROUP BY 1, 2)
SELECT region, bool_or(k >= 2) AS flagged, CAST(max(k) AS BIGINT) AS most_divergent, CAST(sum(bins) AS BIGINT) AS bins FROM d GROUP BY 1"""
)
def regional_verdict(spark: SparkSession, base: str) -> DataFrame:
    """Regions whose curve leaves the pooled curve by more than two standard errors in two bins of a lead."""
    v = valid(spark, base)
    po = V.reliability(v, ["lead_min"]).select("lead_min", "bin", F.col("freq").alias("f"))
    rg = V.reliability(v.where("region is not null"), ["region", "lead_min"]).where("eff_n >= 20")
    f = F.col("f")
    se = F.sqrt(F.greatest(f, F.lit(1e-6)) * (1 - F.least(f, F.lit(1 - 1e-6))) / F.col("eff_n"))
    d = rg.join(po, ["lead_min", "bin"]).groupBy("region", "lead_min").agg(F.count_if(F.abs(F.col("freq") - f) > 2 * se).alias("k"), F.count(F.lit(1)).alias("bins"))
    return d.groupBy("region").agg(F.bool_or(F.col("k") >= 2).alias("flagged"), F.max("k").alias("most_divergent"), F.sum("bins").alias("bins"))


@query(
    f"""WITH {_V}, a AS (SELECT lead_min, bin, count(*) AS n, sum(w * p) / sum(w) AS mean_p, sum(w * y) / sum(w) AS freq, sum(w) AS sw FROM b GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY lead_min ORDER BY CASE WHEN n >= 100 THEN 1 ELSE 0 END DESC, CASE WHEN n >= 100 THEN bin END DESC NULLS LAST, n DESC, bin DESC) AS r FROM a WHERE n >= 100 OR bin >= 5)
SELECT lead_min, bin, n, round(mean_p, 6) AS mean_p, round(freq, 6) AS freq FROM k WHERE r = 1"""
)
def headline_bin(spark: SparkSession, base: str) -> DataFrame:
    """The highest bin with enough rows; else the fullest of the upper bins."""
    a = V.reliability(valid(spark, base), ["lead_min"]).where("n >= 100 or bin >= 5")
    enough = F.when(F.col("n") >= 100, 1).otherwise(0)
    w = W.partitionBy("lead_min").orderBy(enough.desc(), F.when(enough == 1, F.col("bin")).desc_nulls_last(), F.col("n").desc(), F.col("bin").desc())
    return r6(a.withColumn("r", F.row_number().over(w)).where("r = 1").select("lead_min", "bin", "n", "mean_p", "freq"), "mean_p", "freq")


@query(
    """SELECT count(*) AS n, count(DISTINCT settings_hash) AS n_settings, count(DISTINCT event_time) AS n_events, count(DISTINCT point_id) AS n_points, min(event_time) AS first_event, max(event_time) AS last_event,
 count(*) FILTER (WHERE isnan(raw_prob)) AS n_failed, count(*) FILTER (WHERE outcome IS NULL) AS n_unknown, round(avg(sample_weight), 6) AS mean_weight FROM calibration_corpus"""
)
def corpus_metadata(spark: SparkSession, base: str) -> DataFrame:
    """What a fit checks first: one settings hash, the span, failed and unknown rows."""
    c = corpus(spark, base)
    d = lambda x: F.countDistinct(x)
    return c.agg(F.count(F.lit(1)).alias("n"), d("settings_hash").alias("n_settings"), d("event_time").alias("n_events"), d("point_id").alias("n_points"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
                 F.count_if(F.isnan("raw_prob")).alias("n_failed"), F.count_if(F.col("outcome").isNull()).alias("n_unknown"), F.round(F.avg("sample_weight"), 6).alias("mean_weight"))


@query(
    f"""WITH {_V}, s AS (SELECT lead_min, p, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y > 0 THEN 0 ELSE 1 END) AS neg FROM b GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY lead_min ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY lead_min ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY lead_min) AS ap, sum(neg) OVER (PARTITION BY lead_min) AS an FROM s)
SELECT lead_min, CAST(max(ap) AS BIGINT) AS n_pos, CAST(max(an) AS BIGINT) AS n_neg, round(sum(pos * (an - fp + neg / 2.0)) / (max(ap) * max(an)), 6) AS roc_auc,
       round(sum(pos * (tp / (tp + fp))) / max(ap), 6) AS pr_auc, round(max(2.0 * tp / (2 * tp + fp + ap - tp)), 6) AS best_f1 FROM c GROUP BY 1"""
)
def ranking_metrics(spark: SparkSession, base: str) -> DataFrame:
    return r6(V.ranking(valid(spark, base), ["lead_min"]), "roc_auc", "pr_auc", "best_f1")


@query(
    f"""WITH {_V}, t AS (SELECT lead_min, CAST(i AS INTEGER) * 5 AS thr, p >= i * 0.05::DOUBLE AS pr, y > 0 AS ac FROM b, range(1, 20) q(i)),
c AS (SELECT lead_min, thr, count(*) FILTER (WHERE pr AND ac) AS hits, count(*) FILTER (WHERE NOT pr AND ac) AS misses, count(*) FILTER (WHERE pr AND NOT ac) AS false_alarms, count(*) FILTER (WHERE NOT pr AND NOT ac) AS correct FROM t GROUP BY 1, 2)
SELECT *, round(hits / nullif(hits + misses, 0)::DOUBLE, 6) AS pod, round(false_alarms / nullif(hits + false_alarms, 0)::DOUBLE, 6) AS far, round(hits / nullif(hits + misses + false_alarms, 0)::DOUBLE, 6) AS csi,
  round((hits + correct - ((hits + misses) * (hits + false_alarms) + (correct + misses) * (correct + false_alarms)) / (hits + misses + false_alarms + correct)::DOUBLE) / nullif(hits + misses + false_alarms + correct - ((hits + misses) * (hits + false_alarms) + (correct + misses) * (correct + false_alarms)) / (hits + misses + false_alarms + correct)::DOUBLE, 0), 6) AS hss,
  round((hits - (hits + misses) * (hits + false_alarms) / (hits + misses + false_alarms + correct)::DOUBLE) / nullif(hits + misses + false_alarms - (hits + misses) * (hits + false_alarms) / (hits + misses + false_alarms + correct)::DOUBLE, 0), 6) AS ets,
  round((hits + false_alarms) / nullif(hits + misses, 0)::DOUBLE, 6) AS bias, round(2 * hits / nullif(2 * hits + misses + false_alarms, 0)::DOUBLE, 6) AS f1 FROM c"""
)
def threshold_contingency(spark: SparkSession, base: str) -> DataFrame:
    """2x2 tables and scores for 19 thresholds from counts per distinct probability: the thresholds meet counts, not rows."""
    d = valid(spark, base).groupBy("lead_min", "p").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("neg"))
    t = d.withColumn("thr", F.explode(F.array(*[F.lit(5 * i) for i in range(1, 20)])))
    over = F.col("p") >= (F.col("thr") / 5) * F.lit(0.05)
    s = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    out = t.groupBy("lead_min", "thr").agg(s(over, "pos").alias("hits"), s(~over, "pos").alias("misses"), s(over, "neg").alias("false_alarms"), s(~over, "neg").alias("correct"))
    return out.withColumns({k: F.round(v, 6) for k, v in V.table_scores().items()})


@query(
    f"""WITH {_V}, c AS (SELECT point_id, count(*) AS n, sum(w * (p - y) * (p - y)) / sum(w) AS br, sum(w * y) / sum(w) AS f FROM b GROUP BY 1)
SELECT point_id, n, round(br, 6) AS brier, round(f, 6) AS freq FROM c"""
)
def brier_per_point(spark: SparkSession, base: str) -> DataFrame:
    v = valid(spark, base)
    return r6(v.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), V.brier(F.col("w"), F.col("p"), F.col("y")).alias("brier"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("freq")), "brier", "freq")


@query(
    """WITH t AS (SELECT event_time, point_id, lead_min, CAST(raw_prob AS DOUBLE) AS p, row_number() OVER (PARTITION BY event_time, point_id, lead_min ORDER BY raw_prob DESC NULLS LAST) AS k FROM calibration_corpus WHERE isfinite(raw_prob))
SELECT event_time, point_id, lead_min, round(p, 6) AS p, round(max(p) OVER (PARTITION BY event_time, point_id ORDER BY lead_min), 6) AS p_monotone FROM t WHERE k = 1"""
)
def lead_monotone(spark: SparkSession, base: str) -> DataFrame:
    """Probability of rain by a lead never falls with the lead: running maximum over leads."""
    c = corpus(spark, base).where(V.finite(F.col("raw_prob"))).groupBy("event_time", "point_id", "lead_min").agg(F.max(F.col("raw_prob").cast("double")).alias("p"))
    w = W.partitionBy("event_time", "point_id").orderBy("lead_min").rowsBetween(W.unboundedPreceding, 0)
    return r6(c.withColumn("p_monotone", F.max("p").over(w)), "p", "p_monotone")


@query(
    """WITH s AS (SELECT station_id, unnest(parameter_ids) AS tag, CASE WHEN operation_to IS NULL THEN 'present' ELSE 'past' END AS cls FROM station_catalogue),
n AS (SELECT CASE WHEN operation_to IS NULL THEN 'present' ELSE 'past' END AS cls, count(*) AS n_group FROM station_catalogue GROUP BY 1),
f AS (SELECT cls, tag, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT tag, count(*) AS n_past FROM s WHERE cls = 'past' GROUP BY 1)
SELECT f.cls, f.tag, f.n, n.n_group, round(f.n / n.n_group::DOUBLE, 6) AS rate, coalesce(c.n_past, 0) AS n_past,
  round(CASE WHEN c.n_past > 0 THEN (f.n / n.n_group::DOUBLE) / (c.n_past / (SELECT n_group FROM n WHERE cls = 'past')::DOUBLE) END, 6) AS lift
FROM f JOIN n USING (cls) LEFT JOIN c USING (tag)"""
)
def tag_rates(spark: SparkSession, base: str) -> DataFrame:
    """Frequency of each tag per class and its lift over the control class."""
    c = table(spark, base, "station_catalogue").select("station_id", "parameter_ids", F.when(F.col("operation_to").isNull(), "present").otherwise("past").alias("cls"))
    s = c.select("cls", F.explode("parameter_ids").alias("tag"))
    n = c.groupBy("cls").agg(F.count(F.lit(1)).alias("n_group"))
    f = s.groupBy("cls", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cls") == "past").alias("np"))
    control = W.partitionBy("tag")
    j = f.join(n, "cls").withColumn("n_past", F.sum("np").over(control))
    past = W.partitionBy(F.lit(1))  # a few rows: tags x classes
    j = j.withColumn("g_past", F.max(F.when(F.col("cls") == "past", F.col("n_group"))).over(past)).withColumn("rate", F.col("n") / F.col("n_group"))
    j = j.withColumn("lift", F.when(F.col("n_past") > 0, F.col("rate") / (F.col("n_past") / F.col("g_past"))))
    return r6(j.select("cls", "tag", "n", "n_group", "rate", "n_past", "lift"), "rate", "lift")


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(parameter_ids, 'precip_past10min')) AS with_rain, count(*) FILTER (WHERE list_contains(parameter_ids, 'pressure') AND NOT list_contains(parameter_ids, 'temp_dry')) AS odd FROM station_catalogue"""
)
def tag_membership(spark: SparkSession, base: str) -> DataFrame:
    has = lambda x: F.array_contains("parameter_ids", x)
    return table(spark, base, "station_catalogue").agg(F.count(F.lit(1)).alias("n"), F.count_if(has("precip_past10min")).alias("with_rain"), F.count_if(has("pressure") & ~has("temp_dry")).alias("odd"))
