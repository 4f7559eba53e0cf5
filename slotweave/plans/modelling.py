"""Queries of model design, calibration by season, comparison, refitted thresholds, learning curves, ablation, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slotweave.functions.timeexpr import convective_season
from slotweave.operators import models as M
from slotweave.operators import verification as V
from slotweave.operators.features import standardise
from slotweave.plans.gauges import _WARN, warnings
from slotweave.plans.reports import _V, month, r6, valid
from slotweave.plans.scoring import _DRAW
from slotweave.runtime import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Quantiles of the spline knots, ratio of the tail that asks for a logarithm, names that ask for one.
KNOTS, TAIL = (0.05, 0.275, 0.5, 0.725, 0.95), 10.0


@query(
    f"""WITH {_WARN}, l AS (SELECT 'eta_min' AS name, eta_min AS x FROM w UNION ALL SELECT 'p_rain', p_rain FROM w UNION ALL SELECT 'lead_error_min', lead_error_min FROM w), f AS (SELECT * FROM l WHERE isfinite(x)),
q AS (SELECT name, count(*) AS n, min(x) AS low, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.999) AS p999, {", ".join(f"quantile_cont(x, {p}) AS k{i}" for i, p in enumerate(KNOTS))} FROM f GROUP BY 1)
SELECT name, n, n >= 100 AND low >= 0 AND p999 > 0 AND (p90 <= 0 OR p999 > 10 * p90) AS log1p, CASE WHEN n >= 100 AND len(list_distinct([k0, k1, k2, k3, k4])) >= 3 THEN len(list_distinct([k0, k1, k2, k3, k4])) ELSE 0 END AS n_knots,
 {", ".join(f"round(k{i}, 6) AS k{i}" for i in range(5))} FROM q"""
)
def design_catalogue(spark: SparkSession, base: str) -> DataFrame:
    """How each feature enters a design: with a logarithm (long tail) and with which knots."""
    w = warnings(spark, base)
    cols = ("eta_min", "p_rain", "lead_error_min")
    long = w.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])).alias("f")).select("f.*")
    q = V.quantiles(long, ["name"], "x", (0.0, 0.9, 0.999, *KNOTS), 1.0 / 16)
    n, low, p90, tail = (F.col(c) for c in ("n", "q0", "q1", "q2"))
    k = F.size(F.array_distinct(F.array(*[f"q{i + 3}" for i in range(5)])))
    log1p = (n >= 100) & (low >= 0) & (tail > 0) & ((p90 <= 0) | (tail > TAIL * p90))
    return q.select("name", "n", log1p.alias("log1p"), F.when((n >= 100) & (k >= 3), k).otherwise(0).alias("n_knots"), *[F.round(f"q{i + 3}", 6).alias(f"k{i}") for i in range(5)])


@query(
    f"""WITH {_WARN} SELECT warning_id, round(ln(1 + least(eta_min, 120)), 6) AS x_eta, CASE WHEN eta_min > 120 THEN 1 ELSE 0 END AS eta_capped, CASE WHEN eta_min IS NULL THEN 1 ELSE 0 END AS eta_missing,
 round(sin(2 * pi() * hour(warned_at_utc) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(warned_at_utc) / 24), 6) + 0.0 AS hour_cos, CASE WHEN month(warned_at_utc) BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS is_summer, CASE WHEN month(warned_at_utc) IN (12, 1, 2, 3) THEN 1 ELSE 0 END AS is_winter FROM w"""
)
def design_matrix(spark: SparkSession, base: str) -> DataFrame:
    """The design of every warning: logarithm with cap and indicators, hour as a cycle, season as switches."""
    e, t = F.col("eta_min"), F.col("warned_at_utc")
    s = convective_season(F.month(t))
    flag = lambda c: F.when(c, 1).otherwise(0)
    a = F.hour(t) * (2 * 3.141592653589793 / 24)
    return warnings(spark, base).select(
        "warning_id", F.round(F.log1p(F.least(e, F.lit(120.0))), 6).alias("x_eta"), flag(e > 120).alias("eta_capped"), flag(e.isNull()).alias("eta_missing"), (F.round(F.sin(a), 6) + 0.0).alias("hour_sin"), (F.round(F.cos(a), 6) + 0.0).alias("hour_cos"),
        flag(s == "summer").alias("is_summer"), flag(s == "winter").alias("is_winter"),
    )


_SEAS = "CASE WHEN mon BETWEEN 5 AND 9 THEN 'summer' WHEN mon IN (12, 1, 2, 3) THEN 'winter' ELSE 'shoulder' END"


def curve_sql(name: str, by: str, least: int) -> str:
    """CTEs ending in ``{name}`` (by, x, y): isotonic means of quantile bins by the min-max formula."""
    g = ", ".join(f"quantile_cont(p, {k / 10})" for k in range(11))
    return f"""{name}e AS (SELECT {by} AS g, list_distinct([{g}]) AS ed FROM sv GROUP BY 1 HAVING count(*) >= {least}),
{name}i AS (SELECT g, p, y, greatest(0, least(len(list_filter(ed, lambda e: e <= p)) - 1, len(ed) - 2)) AS bin FROM sv JOIN {name}e ON g = {by}),
{name}b AS (SELECT g, bin, avg(p) AS x, avg(y) AS m, count(*)::DOUBLE AS u FROM {name}i GROUP BY 1, 2), {name}c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) AS i, sum(u) OVER (PARTITION BY g ORDER BY x) AS cu, sum(u * m) OVER (PARTITION BY g ORDER BY x) AS cm FROM {name}b),
{name}z AS (SELECT a.g, a.i AS a, z.i AS z, (z.cm - a.cm + a.u * a.m) / (z.cu - a.cu + a.u) AS v FROM {name}c a JOIN {name}c z ON a.g = z.g AND z.i >= a.i), {name}n AS (SELECT g, a, z AS i, min(v) OVER (PARTITION BY g, a ORDER BY z DESC) AS v FROM {name}z),
{name} AS (SELECT c.g, c.x, f.y, lead(c.x) OVER (PARTITION BY c.g ORDER BY c.x) AS x1, lead(f.y) OVER (PARTITION BY c.g ORDER BY c.x) AS y1, row_number() OVER (PARTITION BY c.g ORDER BY c.x) AS k FROM {name}c c JOIN (SELECT g, i, max(v) AS y FROM {name}n GROUP BY 1, 2) f ON c.g = f.g AND c.i = f.i)"""


_AT = lambda t: f"(SELECT CASE WHEN sv.p < x OR x1 IS NULL THEN y ELSE y + (y1 - y) * (sv.p - x) / (x1 - x) END FROM {t} t WHERE t.g = sv.{'season' if t == 'cs' else 'allg'} AND (t.x <= sv.p OR t.k = 1) ORDER BY t.x DESC LIMIT 1)"


@query(
    f"""WITH {_V}, sv AS (SELECT lead_min, p, y, w, {_SEAS} AS season, 'all' AS allg FROM b), {curve_sql("ca", "allg", 1)}, {curve_sql("cs", "season", 500)},
r AS (SELECT sv.*, {_AT("ca")} AS pa, {_AT("cs")} AS ps FROM sv)
SELECT season, count(*) AS n, count(ps) > 0 AS own_curve, round(avg((p - y) * (p - y)), 6) AS brier_raw, round(avg((pa - y) * (pa - y)), 6) AS brier_pooled, round(avg((coalesce(ps, pa) - y) * (coalesce(ps, pa) - y)), 6) AS brier_season FROM r GROUP BY 1"""
)
def season_calibration(spark: SparkSession, base: str) -> DataFrame:
    """Isotonic curves over quantile bins, pooled and per season; a season with too few rows falls back to the pooled curve."""
    v = valid(spark, base).withColumn("season", convective_season(month(F.col("event_time")))).select("season", "p", "y")
    pooled = M.binned_curves(v.withColumn("g", F.lit("all")), ["g"], bins=10).select(F.col("xs").alias("ax"), F.col("ys").alias("ay"))
    own = M.binned_curves(v, ["season"], bins=10, least=500)
    j = v.join(own, "season", "left").join(F.broadcast(pooled))  # one row
    j = j.withColumns({"pa": M.interpolated(F.col("p"), F.col("ax"), F.col("ay")), "ps": M.interpolated(F.col("p"), F.col("xs"), F.col("ys"))})
    b = lambda c: F.avg(F.pow(c - F.col("y"), 2))
    g = j.groupBy("season").agg(F.count(F.lit(1)).alias("n"), (F.count("ps") > 0).alias("own_curve"), b(F.col("p")).alias("brier_raw"), b(F.col("pa")).alias("brier_pooled"), b(F.coalesce("ps", "pa")).alias("brier_season"))
    return r6(g, "brier_raw", "brier_pooled", "brier_season")


@query(
    f"""WITH {_V}, x AS (SELECT lead_min, substr(event_time, 1, 10) AS day, unnest(['pooled', 'set ' || point_set]) AS stratum, unnest([30, 50, 70]) AS thr_, p, y FROM b),
x2 AS (SELECT lead_min, substr(event_time, 1, 10) AS day, s AS stratum, t AS thr, p >= t / 100.0 AS a, p >= (t + 10) / 100.0 AS c, y > 0 AS o FROM b, (SELECT unnest([30, 50, 70]) AS t), LATERAL (SELECT unnest(['pooled', 'set ' || point_set]) AS s)),
d AS (SELECT stratum, lead_min, thr, day, count(*) FILTER (a AND o) AS ah, count(*) FILTER (a OR o) AS au, count(*) FILTER (c AND o) AS ch, count(*) FILTER (c OR o) AS cu FROM x2 GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum, lead_min, thr ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY stratum, lead_min, thr) AS n FROM d),
r AS (SELECT stratum, lead_min, thr, n, i, CAST(s AS BIGINT) AS s, CAST(floor({_DRAW("'9'", "CAST(lead_min AS VARCHAR)", "CAST(s AS VARCHAR)", "CAST(i AS VARCHAR)")} * n) AS BIGINT) AS j FROM k, range(100) q(s)),
t AS (SELECT r.stratum, r.lead_min, r.thr, r.s, sum(ch) / nullif(sum(cu), 0)::DOUBLE - sum(ah) / nullif(sum(au), 0)::DOUBLE AS v FROM r JOIN k ON r.stratum = k.stratum AND r.lead_min = k.lead_min AND r.thr = k.thr AND r.j = k.i GROUP BY 1, 2, 3, 4),
o AS (SELECT stratum, lead_min, thr, sum(ch) / nullif(sum(cu), 0)::DOUBLE - sum(ah) / nullif(sum(au), 0)::DOUBLE AS diff, max(n) AS n_days FROM k GROUP BY 1, 2, 3)
SELECT stratum, lead_min, thr, n_days, round(diff, 6) + 0.0 AS diff, round(quantile_cont(v, 0.025), 6) + 0.0 AS lo, round(quantile_cont(v, 0.975), 6) + 0.0 AS hi FROM o JOIN t USING (stratum, lead_min, thr) GROUP BY 1, 2, 3, 4, o.diff"""
)
def paired_comparison(spark: SparkSession, base: str) -> DataFrame:
    """A rule and one ten points stricter on the same days: difference of CSI with a paired day-block interval, over strata, leads and thresholds; days shrink to counts first."""
    p, o = F.col("p"), F.col("y") > 0
    v = valid(spark, base).withColumn("stratum", F.explode(F.array(F.lit("pooled"), F.concat_ws(" ", F.lit("set"), "point_set")))).withColumn("thr", F.explode(F.array(F.lit(30), F.lit(50), F.lit(70))))
    a, c = p >= F.col("thr") / 100.0, p >= (F.col("thr") + 10) / 100.0
    by = ["stratum", "lead_min", "thr"]
    d = v.groupBy(*by, F.substring("event_time", 1, 10).alias("day")).agg(F.count_if(a & o).alias("ah"), F.count_if(a | o).alias("au"), F.count_if(c & o).alias("ch"), F.count_if(c | o).alias("cu"))
    k = d.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("day")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    k = cut(k)  # a row per stratum, lead, threshold and day
    diff = V.ratio(F.sum("ch"), F.sum("cu")) - V.ratio(F.sum("ah"), F.sum("au"))
    r = k.select(*by, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("s"))
    r = r.withColumn("j", F.floor(V.hash_draw(F.col("lead_min"), F.col("s"), F.col("i"), seed=9) * F.col("n")))
    t = r.drop("i", "n").join(k.withColumnRenamed("i", "j"), [*by, "j"]).groupBy(*by, "s").agg(diff.alias("v"))
    q = t.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # a hundred values a cell
    out = k.groupBy(*by).agg(diff.alias("diff"), F.max("n").alias("n_days")).join(q, by)
    return out.select(*by, "n_days", *[(F.round(c, 6) + 0.0).alias(n) for n, c in (("diff", F.col("diff")), ("lo", F.get("q", F.lit(0))), ("hi", F.get("q", F.lit(1))))])


_DAILY = f"""{_V}, dc AS (SELECT lead_min, substr(event_time, 1, 10) AS day, t AS thr, count(*) FILTER (p >= t / 100.0 AND y > 0) AS h, count(*) FILTER (p < t / 100.0 AND y > 0) AS m, count(*) FILTER (p >= t / 100.0 AND NOT y > 0) AS f FROM b, (SELECT unnest(range(10, 95, 5)) AS t) GROUP BY 1, 2, 3)"""


def daily_counts(spark: SparkSession, base: str) -> DataFrame:
    v = valid(spark, base).groupBy("lead_min", F.substring("event_time", 1, 10).alias("day"), "p").agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(F.col("y") <= 0).alias("neg"))
    v = v.withColumn("thr", F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(5))))
    over = F.col("p") >= F.col("thr") / 100.0
    s = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    return v.groupBy("lead_min", "day", "thr").agg(s(over, "pos").alias("h"), s(~over, "pos").alias("m"), s(over, "neg").alias("f"))


@query(
    f"""WITH {_DAILY}, tr AS (SELECT lead_min, day, thr, h, m, f, sum(h) OVER g - h AS th, sum(m) OVER g - m AS tm, sum(f) OVER g - f AS tf FROM dc WINDOW g AS (PARTITION BY lead_min, thr)),
sc AS (SELECT *, th / nullif(th + tf, 0)::DOUBLE AS pr, th / nullif(th + tm, 0)::DOUBLE AS re FROM tr), sv AS (SELECT lead_min, day, pr AS sp, re AS sr FROM sc WHERE thr = 50),
ck AS (SELECT sc.*, coalesce(pr >= sp AND re >= sr, false) AS ok, 2 * pr * re / (pr + re) AS f1 FROM sc JOIN sv USING (lead_min, day) WHERE pr > 0 AND re > 0),
pk AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY lead_min, day ORDER BY ok DESC, round(f1, 9) DESC, thr) = 1)
SELECT lead_min, day, thr AS pick, ok AS beats_served, round(f1, 6) AS f1_train, h AS hits, m AS misses, f AS false_alarms FROM pk"""
)
def refitted_thresholds(spark: SparkSession, base: str) -> DataFrame:
    """Each day held out: the threshold picked on the other days (beating the served one in precision and recall if any does, then by F1) and its counts on the day; totals less own counts, no copy per fold."""
    d = daily_counts(spark, base)
    g = W.partitionBy("lead_min", "thr")
    t = d.withColumns({f"t{c}": F.sum(c).over(g) - F.col(c) for c in "hmf"})
    t = t.withColumns({"pr": V.ratio(F.col("th"), F.col("th") + F.col("tf")), "re": V.ratio(F.col("th"), F.col("th") + F.col("tm"))})
    fold = W.partitionBy("lead_min", "day")
    served = lambda c: F.max(F.when(F.col("thr") == 50, F.col(c))).over(fold)
    t = t.withColumns({"sp": served("pr"), "sr": served("re")}).where("pr > 0 and re > 0")
    t = t.withColumns({"ok": F.coalesce((F.col("pr") >= F.col("sp")) & (F.col("re") >= F.col("sr")), F.lit(False)), "f1": 2 * F.col("pr") * F.col("re") / (F.col("pr") + F.col("re"))})
    k = F.row_number().over(fold.orderBy(F.col("ok").desc(), F.round("f1", 9).desc(), "thr"))
    return t.withColumn("k", k).where("k = 1").select("lead_min", "day", F.col("thr").alias("pick"), F.col("ok").alias("beats_served"), F.round("f1", 6).alias("f1_train"), F.col("h").alias("hits"), F.col("m").alias("misses"), F.col("f").alias("false_alarms"))


@query(
    f"""WITH {_V}, s AS (SELECT lead_min, unnest(['pooled', 'season ' || {_SEAS}, 'set ' || point_set, 'region ' || coalesce(region, 'none')]) AS subset, p, y, w FROM b)
SELECT lead_min, subset, count(*) AS n, round(sum(w * y) / sum(w), 6) AS base_rate, round(sum(w * (p - y) * (p - y)) / sum(w), 6) AS brier, round(1 - (sum(w * (p - y) * (p - y)) / sum(w)) / nullif((sum(w * y) / sum(w)) * (1 - sum(w * y) / sum(w)), 0), 6) AS bss FROM s GROUP BY 1, 2"""
)
def subset_scores(spark: SparkSession, base: str) -> DataFrame:
    """Skill per lead and subset; a row counts in each of its subsets."""
    season = convective_season(month(F.col("event_time")))
    label = F.array(F.lit("pooled"), F.concat_ws(" ", F.lit("season"), season), F.concat_ws(" ", F.lit("set"), "point_set"), F.concat_ws(" ", F.lit("region"), F.coalesce("region", F.lit("none"))))
    p, y, w = F.col("p"), F.col("y"), F.col("w")
    g = valid(spark, base).withColumn("subset", F.explode(label)).groupBy("lead_min", "subset").agg(F.count(F.lit(1)).alias("n"), V.ratio(F.sum(w * y), F.sum(w)).alias("base_rate"), V.brier(w, p, y).alias("brier"))
    base_ = F.col("base_rate")
    return r6(g.withColumn("bss", 1 - V.ratio(F.col("brier"), base_ * (1 - base_))), "base_rate", "brier", "bss")


_RANK = "dy AS (SELECT day, row_number() OVER (ORDER BY md5('3|' || day), day) AS r FROM (SELECT DISTINCT substr(event_time, 1, 10) AS day FROM b))"


@query(
    f"""WITH {_V}, {_RANK}, bu AS (SELECT unnest([1, 2, 4, 8]) AS days), x AS (SELECT b.lead_min, b.bin, b.p, b.y, b.w, dy.r FROM b JOIN dy ON dy.day = substr(event_time, 1, 10)),
ct AS (SELECT days, lead_min, bin, sum(w * y) / sum(w) AS q FROM x, bu WHERE r <= days GROUP BY 1, 2, 3)
SELECT bu.days, x.lead_min, count(*) AS n, round(sum(w * (p - y) * (p - y)) / sum(w), 6) AS brier_raw, round(sum(w * (coalesce(q, p) - y) * (coalesce(q, p) - y)) / sum(w), 6) AS brier_trained FROM x JOIN bu ON x.r > bu.days LEFT JOIN ct ON ct.days = bu.days AND ct.lead_min = x.lead_min AND ct.bin = x.bin GROUP BY 1, 2"""
)
def learning_curve(spark: SparkSession, base: str) -> DataFrame:
    """Skill on unseen days by the number of training days (nested draws by a fixed hash): bins are trained on the drawn days; rows shrink to moments per day and bin first."""
    v = valid(spark, base).withColumns({"day": F.substring("event_time", 1, 10), "bin": V.bin_of(F.col("p"))})
    w, p, y = F.col("w"), F.col("p"), F.col("y")
    s = v.groupBy("lead_min", "day", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"), F.sum(w * F.pow(p - y, 2)).alias("se"))
    s = cut(s)  # leads x days x bins
    days = s.select("day").distinct().withColumn("r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.md5(F.concat_ws("|", F.lit("3"), "day")), "day")))  # one row a day
    x = s.join(days, "day").withColumn("days", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8)])))
    train = x.where("r <= days").groupBy("days", "lead_min", "bin").agg((F.sum("sy") / F.sum("sw")).alias("q"))
    t = x.where("r > days").join(train, ["days", "lead_min", "bin"], "left")
    fit = F.when(F.col("q").isNull(), F.col("se")).otherwise(F.col("syy") - 2 * F.col("q") * F.col("sy") + F.col("q") * F.col("q") * F.col("sw"))
    return r6(t.groupBy("days", "lead_min").agg(F.sum("n").alias("n"), (F.sum("se") / F.sum("sw")).alias("brier_raw"), (F.sum(fit) / F.sum("sw")).alias("brier_trained")), "brier_raw", "brier_trained")


_FAMILIES = {"all": ("bin", "season", "point_set"), "without season": ("bin", "point_set"), "without set": ("bin", "season"), "without probability": ("season", "point_set")}


def _ablation_sql() -> str:
    parts = []
    for name, cols in _FAMILIES.items():
        by = ", ".join(cols)
        parts.append(f"SELECT '{name}' AS family, lead_min, sum((sw_ - sw) * 0 + CASE WHEN ow > 0 THEN syy - 2 * (oy / ow) * sy + (oy / ow) * (oy / ow) * sw ELSE syy - 2 * base * sy + base * base * sw END) AS loss, sum(sw) AS tw, sum(n) AS n FROM (SELECT *, sum(sw) OVER c - sw AS ow, sum(sy) OVER c - sy AS oy, sum(sw) OVER c AS sw_ FROM (SELECT lead_min, fold, {by}, sum(n) AS n, sum(sw) AS sw, sum(sy) AS sy, sum(syy) AS syy, max(base) AS base FROM mo GROUP BY lead_min, fold, {by}) WINDOW c AS (PARTITION BY lead_min, {by})) GROUP BY 2")
    return f"""WITH {_V}, m0 AS (SELECT lead_min, substr(event_time, 1, 10) AS fold, bin, {_SEAS} AS season, point_set, count(*) AS n, sum(w) AS sw, sum(w * y) AS sy, sum(w * y * y) AS syy FROM b GROUP BY 1, 2, 3, 4, 5),
mo AS (SELECT *, sum(sy) OVER (PARTITION BY lead_min) / sum(sw) OVER (PARTITION BY lead_min) AS base FROM m0), u AS ({" UNION ALL ".join(parts)})
SELECT family, lead_min, CAST(n AS BIGINT) AS n, round(loss / tw, 6) AS brier, round(loss / tw - max(CASE WHEN family = 'all' THEN loss / tw END) OVER (PARTITION BY lead_min), 6) + 0.0 AS worse_by FROM u"""


@query(_ablation_sql())
def ablation(spark: SparkSession, base: str) -> DataFrame:
    """Out-of-day loss of cell means over all features and without each family: moments per cell once, the other days' sums are totals less own."""
    v = valid(spark, base).withColumns({"fold": F.substring("event_time", 1, 10), "bin": V.bin_of(F.col("p")), "season": convective_season(month(F.col("event_time")))})
    w, y = F.col("w"), F.col("y")
    m = v.groupBy("lead_min", "fold", "bin", "season", "point_set").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"))
    lead = W.partitionBy("lead_min")
    m = cut(m.withColumn("base", F.sum("sy").over(lead) / F.sum("sw").over(lead)))  # a row per cell and day
    out = None
    for name, cols in _FAMILIES.items():
        g = m.groupBy("lead_min", "fold", *cols).agg(*[F.sum(c).alias(c) for c in ("n", "sw", "sy", "syy")], F.max("base").alias("base"))
        c = W.partitionBy("lead_min", *cols)
        g = g.withColumns({"ow": F.sum("sw").over(c) - F.col("sw"), "oy": F.sum("sy").over(c) - F.col("sy")})
        q = F.when(F.col("ow") > 0, F.col("oy") / F.col("ow")).otherwise(F.col("base"))
        one = g.groupBy("lead_min").agg(F.sum("n").alias("n"), (F.sum(F.col("syy") - 2 * q * F.col("sy") + q * q * F.col("sw")) / F.sum("sw")).alias("brier")).withColumn("family", F.lit(name))
        out = one if out is None else out.unionByName(one)
    whole = F.max(F.when(F.col("family") == "all", F.col("brier"))).over(W.partitionBy("lead_min"))
    return out.select("family", "lead_min", "n", F.round("brier", 6).alias("brier"), (F.round(F.col("brier") - whole, 6) + 0.0).alias("worse_by"))


@query(
    f"""WITH {_WARN}, r AS (SELECT outcome = 'hit' AS o, CASE WHEN isfinite(p_rain) THEN p_rain END AS a, CASE WHEN isfinite(eta_min) THEN 1 / (1 + greatest(eta_min, 0) / 20.0) END AS c FROM w WHERE outcome IS NOT NULL),
u AS (SELECT 'first' AS family, a >= 0.5 AS fire, o FROM r UNION ALL SELECT 'second', c >= 0.5, o FROM r UNION ALL SELECT 'or', CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN a >= 0.5 OR c >= 0.5 END, o FROM r
 UNION ALL SELECT 'and', CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN a >= 0.5 AND c >= 0.5 END, o FROM r UNION ALL SELECT 'blend', 0.3 * a + 0.7 * c >= 0.5, o FROM r)
SELECT family, count(*) FILTER (fire AND o) AS hits, count(*) FILTER (NOT fire AND o) AS misses, count(*) FILTER (fire AND NOT o) AS false_alarms, count(*) FILTER (NOT fire AND NOT o) AS correct, count(*) FILTER (fire IS NULL) AS skipped FROM u GROUP BY 1"""
)
def rule_families(spark: SparkSession, base: str) -> DataFrame:
    """Rules on two probabilities: either alone, or, and, blend; a row without what its rule reads is skipped."""
    a = V.finite_or_null(F.col("p_rain"))
    c = F.when(V.finite(F.col("eta_min")), 1 / (1 + F.greatest(F.col("eta_min"), F.lit(0.0)) / 20.0))
    both = a.isNotNull() & c.isNotNull()
    ways = {"first": a >= 0.5, "second": c >= 0.5, "or": F.when(both, (a >= 0.5) | (c >= 0.5)), "and": F.when(both, (a >= 0.5) & (c >= 0.5)), "blend": 0.3 * a + 0.7 * c >= 0.5}
    x = warnings(spark, base).where("outcome is not null").select((F.col("outcome") == "hit").alias("o"), F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("fire")) for k, v in ways.items()])).alias("x")).select("o", "x.*")
    return x.groupBy("family").agg(*V.contingency(F.col("fire"), F.col("o")), F.count_if(F.col("fire").isNull()).alias("skipped"))


@query()
def logistic_skill(spark: SparkSession, base: str) -> DataFrame:
    """Penalised logistic models out of fold (days dealt to five folds), on standardised features; scores per lead. Held against numpy in the tests."""
    v = valid(spark, base)
    s = F.col("p") * 0.98 + 0.01
    v = v.withColumns({"logit": F.log(s / (1 - s)), "lead": F.col("lead_min").cast("double"), "square": F.col("p") * F.col("p"), "summer": F.when(month(F.col("event_time")).between(5, 9), 1.0).otherwise(0.0)})
    f = ["logit", "lead", "square", "summer"]
    z = cut(M.folds_of(standardise(v, f), F.substring("event_time", 1, 10), 5).select("lead_min", "p", "y", "w", "fold", *[f"z_{c}" for c in f]))
    cols = [f"z_{c}" for c in f]
    q = M.predict_logistic(z, cols, M.fit_logistic(z, cols, y="y", w="w"))
    return r6(q.groupBy("lead_min").agg(F.count(F.lit(1)).alias("n"), V.brier(F.col("w"), F.col("p"), F.col("y")).alias("brier_raw"), V.brier(F.col("w"), F.col("q"), F.col("y")).alias("brier_model")), "brier_raw", "brier_model")


@query()
def forest_scores(spark: SparkSession, base: str) -> DataFrame:
    """Boosted trees trained on the warnings' outcomes and evaluated on all of them, after a way through JSON. Held against plain recursion in the tests."""
    w = warnings(spark, base).select("warning_id", "p_rain", "eta_min", F.hour("warned_at_utc").cast("double").alias("hour"), F.when(F.col("outcome").isNotNull(), (F.col("outcome") == "hit").cast("double")).alias("y"))
    w = cut(w)
    m = M.fit_trees(w.where("y is not null"), ["p_rain", "eta_min", "hour"], y="y")
    s = M.raw_score(w, M.load(M.dump(m)))
    return s.select("warning_id", F.round("raw", 9).alias("raw"), F.round(1 / (1 + F.exp(-F.col("raw"))), 9).alias("probability"))
