"""Point events (strikes) seen from targets: cells of near events, their motion, and when they reach rings around a target.

Everything is relational: events meet targets through the spatial operator, cells are connected components of an equi-join over
grid cells, motion is a regression aggregate, states and arrival times are expressions. Nothing depends on one target's or one cell's size in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.geo import haversine_km, local_km
from slotweave.functions.timeexpr import MICROS
from slotweave.operators import spatial
from slotweave.operators.components import connected_components
from slotweave.runtime import cut

MIN_US = 60 * MICROS
#: Fixed values of the tracking: events needed, cell distance (km), reach (km), recent part of a cell (min), least closing speed (km/h), least span of a fit (min).
LEAST, EPS_KM, REACH_KM, RECENT_MIN, CLOSING_KMH, SPAN_MIN = 6, 15.0, 60.0, 5.0, 5.0, 3.0


def instants(us: Column, stride_min: int, buffer_min: int) -> Column:
    """The multiples of the stride at which an event lies in the buffer ``(T - buffer, T]``: an array."""
    s = F.lit(stride_min * MIN_US)
    first = us + F.pmod(-us, s)
    return F.filter(F.sequence(first, first + F.lit(buffer_min * MIN_US), s), lambda t: t < us + F.lit(buffer_min * MIN_US))


def around(strikes: DataFrame, targets: DataFrame, *, stride_min: int, buffer_min: int, least: int = LEAST, reach_km: float = REACH_KM) -> DataFrame:
    """``target, at_us, id, lat, lon, us, km, tlat, tlon``: the events in reach of each target at each instant with ``least`` of them or more.

    ``strikes``: ``id, lat, lon, us``; ``targets``: ``target, lat, lon``. Rows with nulls match nothing.
    """
    null = F.lit(None).cast("array<array<double>>")
    circles = targets.select(F.lit("target").alias("kind"), F.col("target").alias("id"), "lat", "lon", F.lit(reach_km).alias("km"), null.alias("rings_lon"), null.alias("rings_lat"))
    met = spatial.match_sites(strikes.select(F.col("id").alias("point_id"), "lat", "lon"), circles).select(F.col("point_id").cast("long").alias("id"), F.col("found_id").alias("target"), "km")
    rows = met.join(strikes.where("us is not null"), "id").join(targets.select("target", F.col("lat").alias("tlat"), F.col("lon").alias("tlon")), "target")
    rows = rows.withColumn("at_us", F.explode(instants(F.col("us"), stride_min, buffer_min)))
    many = rows.groupBy("target", "at_us").agg(F.count(F.lit(1)).alias("n_strikes")).where(F.col("n_strikes") >= least)
    return rows.join(many, ["target", "at_us"])


def cells(near: DataFrame, eps_km: float = EPS_KM) -> DataFrame:
    """Adds ``cell``: the least id of the events linked by steps of ``eps_km`` at most, per target and instant."""
    near = cut(near.withColumns({"g": F.concat_ws("|", "target", "at_us"), "node": F.concat_ws("|", "target", "at_us", F.lpad(F.col("id").cast("string"), 19, "0"))}))
    pairs = spatial.near_pairs(near, "node", eps_km, group="g").select("a", "b")
    found = connected_components(near.select(F.col("node").alias("id")), pairs).select(F.col("id").alias("node"), "component")
    return near.join(found, "node").withColumn("cell", F.substring_index("component", "|", -1).cast("long")).drop("g", "node", "component")


def motion(members: DataFrame) -> DataFrame:
    """One row per (target, instant, cell): number, centre, spread, age, leading edge, least-squares motion and its residual, closing speed, bearing, confidence."""
    key = ["target", "at_us", "cell"]
    t = (F.col("us") - F.col("at_us")) / F.lit(float(MIN_US))
    east, north = local_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))
    m = members.withColumns({"t": t, "e": east, "n": north})
    one = m.groupBy(*key).agg(
        F.max("n_strikes").alias("n_strikes"), F.count(F.lit(1)).alias("size"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"), F.avg("e").alias("ce"), F.avg("n").alias("cn"), F.max("t").alias("last"), (F.max("t") - F.min("t")).alias("span"),
        F.regr_slope("e", "t").alias("ve"), F.regr_slope("n", "t").alias("vn"), F.regr_intercept("e", "t").alias("ie"), F.regr_intercept("n", "t").alias("in"),
    )
    j = m.drop("n_strikes").join(one, key)
    off = F.pow(F.col("e") - F.col("ie") - F.col("ve") * F.col("t"), 2) + F.pow(F.col("n") - F.col("in") - F.col("vn") * F.col("t"), 2)
    two = j.groupBy(*key).agg(
        F.avg(haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))).alias("spread_km"), F.min(F.when(F.col("last") - F.col("t") <= RECENT_MIN, F.col("km"))).alias("edge_km"), F.sqrt(F.avg(off)).alias("resid"),
    )
    c = one.join(two, key)
    fitted, used = (F.col("size") >= 2) & (F.col("span") > 0), (F.col("size") >= 2) & (F.col("span") >= SPAN_MIN)
    norm, speed = F.hypot("ce", "cn"), F.hypot("ve", "vn")
    closing = F.when(used & (norm > 1e-6), -(F.col("ve") * F.col("ce") + F.col("vn") * F.col("cn")) / norm).otherwise(0.0)
    trust = F.least(F.lit(1.0), F.col("size") / (2.0 * LEAST)) * 0.4 + F.least(F.lit(1.0), F.when(fitted, F.col("span")).otherwise(0.0) / 10.0) * 0.3 + 0.3 / (1 + F.when(fitted, F.col("resid")).otherwise(0.0) / 3.0)
    return c.select(
        *key, "n_strikes", "size", "clat", "clon", "spread_km", (-F.col("last")).alias("age_min"), "edge_km", (closing * 60).alias("closing_kmh"), F.when(used, speed * 60).alias("speed_kmh"),
        F.when(used & (speed > 1e-6), F.pmod(F.degrees(F.atan2("ve", "vn")), F.lit(360.0))).alias("bearing"), F.when(used, F.col("ve")).alias("ve"), F.when(used, F.col("vn")).alias("vn"), trust.alias("confidence"),
    )


def state_of(edge_km: Column, closing_kmh: Column, ring_km: float) -> Column:
    """inside, approaching, stalled or receding, by the smallest ring."""
    return F.when(edge_km <= ring_km, "inside").when(closing_kmh < 0, "receding").when(closing_kmh < CLOSING_KMH, "stalled").when(closing_kmh.isNotNull(), "approaching")


def ring_eta(edge_km: Column, closing_kmh: Column, state: Column, ring_km: float) -> Column:
    """Minutes until the edge reaches the ring: 0 inside it, null unless the cell approaches."""
    return F.when(edge_km <= ring_km, 0.0).when(state == "approaching", F.round((edge_km - ring_km) / (closing_kmh / 60), 1))


def outlook(cells_: DataFrame, rings: Sequence[float]) -> DataFrame:
    """One row per (target, instant): the most threatening cell's state and arrival at every ring, and the soonest over all cells.

    Most threatening is the soonest to reach the smallest ring (inside: 0; not closing: never), then the nearest. Over all cells each ring takes the soonest arrival, the state
    is inside, approaching, stalled or receding, whichever comes first.
    """
    one = F.collect_list(F.struct("cell", "edge_km", "closing_kmh", "confidence"))
    return outlook_of(cells_.groupBy("target", "at_us").agg(F.max("n_strikes").alias("n_strikes"), one.alias("cells")), rings)


def judged(seen: DataFrame, rings: Sequence[float]) -> DataFrame:
    """Adds to rows with ``cells`` the most threatening one ``b``, the ``rank`` of the whole and the soonest arrivals ``any_eta_*``; null without cells. No shuffle."""
    rings = sorted(rings)
    etas = [f"eta_{r:g}" for r in rings]

    def one(x: Column) -> Column:
        e, c = x["edge_km"], x["closing_kmh"]
        s = state_of(e, c, rings[0])
        threat = F.when(e <= rings[0], 0.0).when(c < CLOSING_KMH, F.lit(float("inf"))).otherwise((e - rings[0]) / (c / 60))
        rank = F.when(s == "inside", 0).when(s == "approaching", 1).when(s == "stalled", 2).otherwise(3)
        return F.struct(threat.alias("threat"), e.alias("edge_km"), x["cell"].alias("cell"), s.alias("state"), c.alias("closing_kmh"), x["confidence"].alias("confidence"), rank.alias("rank"), *[ring_eta(e, c, s, r).alias(k) for k, r in zip(etas, rings)])

    least = lambda k: F.array_min(F.transform("__j", lambda x: x[k]))
    return seen.withColumn("__j", F.transform("cells", one)).withColumns({"b": F.array_min("__j"), "rank": least("rank")} | {f"any_{k}": least(k) for k in etas}).drop("__j")


def outlook_of(seen: DataFrame, rings: Sequence[float]) -> DataFrame:
    """``outlook`` of rows ``target, at_us, n_strikes, cells``, one per target and instant."""
    etas = [f"eta_{r:g}" for r in sorted(rings)]
    g = judged(seen.where(F.size("cells") > 0), rings)
    whole = F.get(F.array(*[F.lit(n) for n in ("inside", "approaching", "stalled", "receding")]), F.col("rank"))
    return g.select("target", "at_us", "n_strikes", F.size("cells").cast("long").alias("n_cells"), "b.cell", "b.state", "b.edge_km", "b.closing_kmh", "b.confidence", *[f"b.{k}" for k in etas], whole.alias("any_state"), *[f"any_{k}" for k in etas])


def entry_min(e: Column, n: Column, ve: Column, vn: Column, ring_km: float) -> Column:
    """Minutes until a point at (e, n) km moving (ve, vn) km/min enters the ring; 0 inside, null if it never does."""
    a, b, c = ve * ve + vn * vn, 2 * (e * ve + n * vn), e * e + n * n - ring_km * ring_km
    disc = b * b - 4 * a * c
    lo, hi = (-b - F.sqrt(disc)) / (2 * a), (-b + F.sqrt(disc)) / (2 * a)
    return F.when(c <= 0, 0.0).when((a >= 1e-9) & (disc >= 0), F.when(lo >= 0, lo).when(hi >= 0, hi))


def grid_targets(anchors: DataFrame, grid_km: float, radius_km: float) -> DataFrame:
    """``anchor, i, j, lat, lon``: a grid of targets around each anchor (``anchor, lat, lon``) within the radius."""
    k = int(radius_km // grid_km)
    steps = F.sequence(F.lit(-k), F.lit(k))
    g = anchors.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).where(F.hypot(F.col("i") * grid_km, F.col("j") * grid_km) <= radius_km)
    return g.select("anchor", "i", "j", (F.col("lat") + F.col("j") * grid_km / 110.574).alias("lat"), (F.col("lon") + F.col("i") * grid_km / (111.320 * F.cos(F.radians("lat")))).alias("lon"))
