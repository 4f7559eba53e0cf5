"""Points near other points, and regions containing points.

The plane (lon, lat) is cut by a quadtree grown from bounded samples of the points and of the sites, so that crowded places
of either get small cells. Every point lies in exactly one cell; a site (a station's circle, a region) is copied to
every cell its box touches. Each cell's sites are bulk-loaded into a packed R-tree, the cell's points
probe it, candidates are refined exactly, and a pair counts only in the cell that holds its reference point
(the point itself), so copies of a site at a border give no pair twice. A cell that no edge of an area touches lies wholly inside or
outside of it: outside it gets no copy, inside a copy without outline.

Scale: the cell of a crowded place cannot be split below one position, so a cell expected to hold
more than its share is *salted* in both directions: its points are dealt to some groups, its sites to others, and every pair of groups meets once.
Points are reduced to distinct rows in one shuffle. Only the samples (``SAMPLE`` rows each, about) and one row of extent reach
the driver; sites are never broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.geo import EARTH_KM, bearing_deg, haversine_km

SAMPLE = 20_000
MAX_DEPTH = 14
FANOUT = 16


class Quadtree:
    """Leaves of a quadtree over a box, as sorted Z-order ranges at depth ``MAX_DEPTH``."""

    def __init__(self, box: tuple[float, float, float, float], samples: list[tuple[np.ndarray, np.ndarray]], capacities: list[int]):
        """A cell is split while it holds more than the capacity of any sample (``counts``: one row per sample)."""
        self.x0, self.y0, x1, y1 = box
        self.w, self.h = max(x1 - self.x0, 1e-9), max(y1 - self.y0, 1e-9)
        codes = [np.sort(self.code(x, y)) for x, y in samples]
        starts, depths, counts, stack = [], [], [], [(0, 0)]
        while stack:
            start, depth = stack.pop()
            span = 1 << (2 * (MAX_DEPTH - depth))
            n = [int(np.searchsorted(c, start + span) - np.searchsorted(c, start)) for c in codes]
            if depth < MAX_DEPTH and any(k > most for k, most in zip(n, capacities)):
                stack += [(start + i * (span // 4), depth + 1) for i in range(4)]
            else:
                starts.append(start)
                depths.append(depth)
                counts.append(n)
        o = np.argsort(starts)
        self.starts, self.depths, self.counts = np.asarray(starts, np.int64)[o], np.asarray(depths, np.int64)[o], np.asarray(counts, np.int64)[o].T

    def box(self, leaf: int) -> tuple[float, float, float, float]:
        """The leaf's rectangle, a little larger than it is."""
        code, size = int(self.starts[leaf]), 1 << (MAX_DEPTH - int(self.depths[leaf]))
        i = sum(((code >> (2 * b)) & 1) << b for b in range(MAX_DEPTH))
        j = sum(((code >> (2 * b + 1)) & 1) << b for b in range(MAX_DEPTH))
        dx, dy = self.w / (1 << MAX_DEPTH), self.h / (1 << MAX_DEPTH)
        return self.x0 + (i - 1e-6) * dx, self.y0 + (j - 1e-6) * dy, self.x0 + (i + size + 1e-6) * dx, self.y0 + (j + size + 1e-6) * dy

    def _cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = 1 << MAX_DEPTH
        return (np.clip((x - self.x0) / self.w * side, 0, side - 1).astype(np.int64), np.clip((y - self.y0) / self.h * side, 0, side - 1).astype(np.int64))

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = self._cell(np.asarray(x, float), np.asarray(y, float))
        out = np.zeros(len(i), np.int64)
        for b in range(MAX_DEPTH):
            out |= ((i >> b) & 1) << (2 * b) | ((j >> b) & 1) << (2 * b + 1)
        return out

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(x, y), side="right") - 1

    def leaves_in(self, bx0: float, by0: float, bx1: float, by1: float) -> list[int]:
        """Leaves whose cell touches the box."""
        (i0, i1), (j0, j1) = self._cell(np.array([bx0, bx1]), np.array([by0, by1]))
        out, stack = [], [(0, 0, 0, 0)]
        while stack:
            start, depth, i, j = stack.pop()
            size = 1 << (MAX_DEPTH - depth)
            if i > i1 or j > j1 or i + size - 1 < i0 or j + size - 1 < j0:
                continue
            k = int(np.searchsorted(self.starts, start, side="right") - 1)
            ends = self.starts[k + 1] if k + 1 < len(self.starts) else 1 << (2 * MAX_DEPTH)
            if self.starts[k] <= start and start + size * size <= ends:
                out.append(k)
            else:
                half = size // 2
                stack += [(start + (a | b << 1) * half * half, depth + 1, i + a * half, j + b * half) for a in (0, 1) for b in (0, 1)]
        return sorted(set(out))


class RTree:
    """Boxes packed bottom-up (sort-tile-recursive); probed by many points at once, level by level."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        slices = max(1, math.ceil(math.sqrt(math.ceil(n / FANOUT))))
        by_x = np.argsort(boxes[:, 0] + boxes[:, 2], kind="stable")
        order = np.concatenate([s[np.argsort((boxes[s, 1] + boxes[s, 3]), kind="stable")] for s in np.array_split(by_x, slices)]) if n else by_x
        self.ids, self.levels = order, [boxes[order]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append(np.column_stack([np.minimum.reduceat(low[:, 0], cut), np.minimum.reduceat(low[:, 1], cut), np.maximum.reduceat(low[:, 2], cut), np.maximum.reduceat(low[:, 3], cut)]))

    def probe(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices (point, box) of all pairs with the point inside the closed box."""
        if not len(self.ids) or not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            b = self.levels[depth][node]
            ok = (x[p] >= b[:, 0]) & (y[p] >= b[:, 1]) & (x[p] <= b[:, 2]) & (y[p] <= b[:, 3])
            p, node = p[ok], node[ok]
            if depth:
                width = len(self.levels[depth - 1])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                p = np.repeat(p, FANOUT)
                p, node = p[node < width], node[node < width]
        return p, self.ids[node]


def km_between(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    s = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, s)))


def inside_rings(x: np.ndarray, y: np.ndarray, rings: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Even-odd rule over all rings at once (holes are further rings, whichever way they turn, closed or not)."""
    odd = np.zeros(len(x), bool)
    for rx, ry in rings:
        ax, ay, bx, by = rx, ry, np.roll(rx, -1), np.roll(ry, -1)
        for k in range(len(rx)):
            if ay[k] == by[k]:
                continue
            across = (ay[k] > y) != (by[k] > y)
            odd ^= across & (x < (bx[k] - ax[k]) * (y - ay[k]) / (by[k] - ay[k]) + ax[k])
    return odd


def circle_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """A box in (lon, lat) that holds the circle."""
    dlat = math.degrees(km / EARTH_KM) * 1.000001
    edge = max(abs(lat - dlat), abs(lat + dlat))
    dlon = 180.0 if edge >= 90 else min(180.0, math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM) / max(1e-12, math.cos(math.radians(lat)))))) * 1.000001)
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def pieces(box: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """A circle's box as boxes within [-180, 180]: one that crosses the 180th meridian falls in two."""
    a, b, c, d = box
    if c - a >= 360:
        return [(-180.0, b, 180.0, d)]
    if a < -180:
        return [(-180.0, b, c, d), (a + 360, b, 180.0, d)]
    if c > 180:
        return [(a, b, 180.0, d), (-180.0, b, c - 360, d)]
    return [box]


def near_pairs(places: DataFrame, key: str, km: float, group: str | None = None) -> DataFrame:
    """Pairs of places within ``km`` of each other, both ways round: ``a, b, km, bearing`` (from a to b).

    ``places``: ``key, lat, lon`` (degrees, longitudes within [-180, 180]). Bands of latitude as high as the distance, each cut into cells at least as wide as the distance is anywhere in
    the band or its neighbours; a place is copied to the cells its circle can touch in three bands, over the 180th meridian and the poles too. An equi-join, no cross join; rows with a null or NaN value
    match nothing, equal keys are no pair. With ``group`` only places of one group are paired (a null group pairs nothing), and the column is kept.
    """
    r = km / EARTH_KM
    size = math.degrees(r) * 1.000001
    more = [group] if group else []
    ok = places.select(key, "lat", "lon", *more).where(f"{key} is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")

    def cells(band: Column) -> Column:
        """How many cells a band has, by its latitude farthest from the equator (as of the neighbours)."""
        edge = F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(size)
        half = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(r, math.pi / 2))) / F.cos(F.radians(F.least(edge, F.lit(89.999999)))))))
        return F.when(edge >= 89, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / (half * 1.000001)))).cast("long")

    at = lambda lon, n: F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / (F.lit(360.0) / n)).cast("long")
    band = F.floor(F.col("lat") / F.lit(size)).cast("long")
    a = ok.select(F.col(key).alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), band.alias("i"), at(F.col("lon"), cells(band)).alias("j"), *more)
    near = F.explode(F.array(band - 1, band, band + 1))
    b = ok.select(F.col(key).alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), near.alias("i"), *more).withColumn("n", cells(F.col("i")))
    own = at(F.col("blon"), F.col("n"))
    b = b.withColumn("j", F.explode(F.array_distinct(F.array(*[F.pmod(own + k, F.col("n")) for k in (-1, 0, 1)]))))
    pairs = a.join(b, ["i", "j", *more]).where("a <> b").withColumn("km", haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    return pairs.where(F.col("km") <= km).select(*more, "a", "b", "km", bearing_deg(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")).alias("bearing"))


#: One site: a circle (``km`` set) or an area (``rings_*`` set), with its box.
SITE = "kind string, id string, lat double, lon double, km double, rings_lon array<array<double>>, rings_lat array<array<double>>"
PAIR = "point_id string, found_kind string, found_id string, km double"


def match_sites(points: DataFrame, sites: DataFrame, *, cell_rows: int = 50_000) -> DataFrame:
    """Pairs (point, site) with the point within the circle (boundary included) or inside the area.

    ``points``: ``point_id, lat, lon``, reduced to distinct rows here. ``sites``: columns of ``SITE``.
    Points and sites with a null or NaN coordinate match nothing. Areas are judged in straight lon/lat lines; circles are joined
    across the 180th meridian and the poles (longitudes within [-180, 180]). Result: ``PAIR`` (``km`` null for areas), no pair twice for one
    position; empty inputs give no rows. ``cell_rows`` is the number of points, and of sites, a group should hold.
    """
    spark = points.sparkSession
    usable = points.select(F.col("point_id").cast("string").alias("point_id"), F.col("lat").cast("double"), F.col("lon").cast("double"))
    usable = usable.where("point_id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    stat = usable.agg(F.approx_count_distinct(F.xxhash64("point_id", "lat", "lon")), F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    n, box = stat[0], tuple(stat[1:])
    if not n:
        return spark.createDataFrame([], PAIR)

    # the samples decide only where cells lie; every row is matched whatever they hold
    def sampled(rows: DataFrame, about: int) -> np.ndarray:
        if about > SAMPLE:
            rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)) < int(SAMPLE / about * 1_000_000)).distinct().limit(2 * SAMPLE)
        return np.asarray([(r["lon"], r["lat"]) for r in rows.collect()], float).reshape(-1, 2)

    circles = sites.where("km is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("id", F.col("lat").cast("double"), F.col("lon").cast("double"))
    n_sites = circles.count()
    s, c = sampled(usable, n), sampled(circles, n_sites)
    weight, heavy = max(1.0, n / max(1, len(s))), max(1.0, n_sites / max(1, len(c)))
    tree = Quadtree(box, [(s[:, 0], s[:, 1]), (c[:, 0], c[:, 1])], [max(1, int(cell_rows / weight)), max(1, int(cell_rows / heavy))])
    # groups of points and groups of sites per cell
    shares = [np.maximum(1, np.ceil(k * x / (2 * cell_rows))).astype(np.int64) for k, x in zip(tree.counts, (weight, heavy))]

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("lon").to_numpy(), b.column("lat").to_numpy()
            leaf = tree.leaf(x, y)
            times = shares[1][leaf]
            k = np.repeat(np.arange(len(leaf)), times)
            other = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
            salt = (b.column("h").to_numpy() % shares[0][leaf])[k] * times[k] + other
            t = b.take(pa.array(k))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[k]), pa.array(salt), t.column("point_id"), t.column("lat"), t.column("lon")], ["cell", "salt", "point_id", "lat", "lon"])

    def to_all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, take, bare = [], [], []
            for k, r in enumerate(b.to_pylist()):
                edges = None
                if r["km"] is not None:
                    if r["lat"] is None or r["lon"] is None or r["lat"] != r["lat"] or r["lon"] != r["lon"]:
                        continue
                    boxes = pieces(circle_box(r["lat"], r["lon"], r["km"]))
                else:
                    rings = [(np.asarray(p, float), np.asarray(q, float)) for p, q in zip(r["rings_lon"] or [], r["rings_lat"] or []) if len(p)]
                    if not rings:
                        continue
                    ex, ey = (np.concatenate([x[i] for x in rings]) for i in (0, 1))
                    fx, fy = (np.concatenate([np.roll(x[i], -1) for x in rings]) for i in (0, 1))
                    edges = np.minimum(ex, fx), np.minimum(ey, fy), np.maximum(ex, fx), np.maximum(ey, fy)
                    boxes = [(ex.min(), ey.min(), ex.max(), ey.max())]
                for bb in boxes:
                    for leaf in tree.leaves_in(*bb):
                        whole = False
                        if edges is not None:
                            x0, y0, x1, y1 = tree.box(leaf)
                            if not ((edges[0] <= x1) & (edges[2] >= x0) & (edges[1] <= y1) & (edges[3] >= y0)).any():
                                whole = bool(inside_rings(np.array([(x0 + x1) / 2]), np.array([(y0 + y1) / 2]), rings)[0])
                                if not whole:
                                    continue
                        mine = int(r["h"] % shares[1][leaf])
                        for salt in range(int(shares[0][leaf])):
                            out.append((leaf, salt * int(shares[1][leaf]) + mine, *bb, whole))
                            take.append(k)
                            bare.append(whole)
            cols = list(zip(*out)) if out else [()] * 7
            kept = b.take(pa.array(take, pa.int64()))
            none = pa.array(bare, pa.bool_())
            rest = [pc.if_else(none, pa.scalar(None, kept.schema.field(x).type), kept.column(x)) if x.startswith("rings") else kept.column(x) for x in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:6]], pa.array(cols[6], pa.bool_()), *rest],
                ["cell", "salt", "bx0", "by0", "bx1", "by1", "whole", *names],
            )

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = left.column("lon").to_numpy(), left.column("lat").to_numpy()
        boxes = np.column_stack([right.column(c).to_numpy() for c in ("bx0", "by0", "bx1", "by1")]) if right.num_rows else np.empty((0, 4))
        p, q = RTree(boxes).probe(x, y)
        here = tree.leaf(x[p], y[p]) == key[0].as_py()  # the pair's reference point is the point itself
        p, q = p[here], q[here]
        lat, lon, km = (right.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon", "km"))
        round_ = ~np.isnan(km[q])
        ok = right.column("whole").to_numpy(zero_copy_only=False).astype(bool)[q]
        dist = np.full(len(p), np.nan)
        dist[round_] = km_between(y[p[round_]], x[p[round_]], lat[q[round_]], lon[q[round_]])
        ok[round_] = dist[round_] <= km[q[round_]]
        open_ = np.flatnonzero(~round_ & ~ok)
        open_ = open_[np.argsort(q[open_], kind="stable")]
        for part in np.split(open_, np.flatnonzero(np.diff(q[open_])) + 1) if len(open_) else []:
            site = q[part[0]]
            rings = [(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(right.column("rings_lon")[site].as_py(), right.column("rings_lat")[site].as_py())]
            ok[part] = inside_rings(x[p[part]], y[p[part]], rings)
        p, q, dist = p[ok], q[ok], dist[ok]
        return pa.table({
            "point_id": left.column("point_id").take(pa.array(p)), "found_kind": right.column("kind").take(pa.array(q)),
            "found_id": right.column("id").take(pa.array(q)), "km": pa.array(dist, mask=np.isnan(dist)),
        })

    # the salt hangs on the row alone, so a task that runs again deals its rows alike
    hashed = usable.distinct().withColumn("h", F.pmod(F.xxhash64("point_id", "lat", "lon"), F.lit(1 << 30)))
    left = hashed.mapInArrow(to_cells, "cell long, salt long, point_id string, lat double, lon double")
    names = [c.strip().split(" ")[0] for c in SITE.split(", ")]
    dealt = sites.selectExpr(*names).withColumn("h", F.pmod(F.xxhash64("kind", "id", "lat", "lon"), F.lit(1 << 30)))
    right = dealt.mapInArrow(to_all_cells, "cell long, salt long, bx0 double, by0 double, bx1 double, by1 double, whole boolean, " + SITE)
    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(join, PAIR)
