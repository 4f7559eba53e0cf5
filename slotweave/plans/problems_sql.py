"""SQL twins of the problem queries that SQL can express, written without the operators' methods."""

ORACLES: dict[str, str] = {}

_RAIN = """
r AS (
  SELECT station_id, observed_utc, obs_id, date_trunc('hour', observed_utc) AS h,
         CAST(round(greatest(CAST(value AS DOUBLE), 0) * 10) AS BIGINT) AS a,
         coalesce(created_utc, observed_utc) AS arr
  FROM observations
  WHERE parameter_id = 'precip_past10min' AND value IS NOT NULL AND NOT isnan(value) AND station_id IS NOT NULL AND observed_utc IS NOT NULL
)"""

ORACLES["p1_found"] = f"""
WITH {_RAIN},
f AS (SELECT station_id, h, count(*) AS n, sum(a) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc ORDER BY arr DESC, obs_id DESC) AS k FROM r WHERE arr <= h + INTERVAL 70 MINUTE) WHERE k = 1 GROUP BY 1, 2),
l AS (SELECT station_id, h, count(*) AS n, sum(a) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, observed_utc ORDER BY arr DESC, obs_id DESC) AS k FROM r WHERE arr <= h + INTERVAL 25 HOUR) WHERE k = 1 GROUP BY 1, 2)
SELECT station_id, strftime(CAST(h AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS hour_utc
FROM l LEFT JOIN f USING (station_id, h)
WHERE l.n <> coalesce(f.n, 0) OR l.s <> coalesce(f.s, 0)
"""

ORACLES["p1_sliding"] = f"""
WITH {_RAIN},
w AS (SELECT r.*, r.h - i * INTERVAL 1 HOUR AS w0, r.h - i * INTERVAL 1 HOUR + INTERVAL 3 HOUR AS e FROM r, range(3) t(i) WHERE arr <= r.h - i * INTERVAL 1 HOUR + INTERVAL 27 HOUR),
f AS (SELECT station_id, w0, count(*) AS n, sum(a) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, w0, observed_utc ORDER BY arr DESC, obs_id DESC) AS k FROM w WHERE arr <= e + INTERVAL 10 MINUTE) WHERE k = 1 GROUP BY 1, 2),
l AS (SELECT station_id, w0, count(*) AS n, sum(a) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id, w0, observed_utc ORDER BY arr DESC, obs_id DESC) AS k FROM w) WHERE k = 1 GROUP BY 1, 2)
SELECT station_id, strftime(CAST(w0 AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS window_utc,
       coalesce(f.n, 0) AS n_first, CAST(coalesce(f.s, 0) AS BIGINT) AS tenths_first, l.n AS n_last, CAST(l.s AS BIGINT) AS tenths_last
FROM l LEFT JOIN f USING (station_id, w0)
"""

ORACLES["p5_found"] = """
WITH m AS (
  SELECT DISTINCT station_id, (epoch_us(observed_utc) + 300000000) // 600000000 AS k
  FROM observations
  WHERE parameter_id = 'precip_past10min' AND value IS NOT NULL AND NOT isnan(value) AND station_id IS NOT NULL AND observed_utc IS NOT NULL),
d AS (SELECT DISTINCT station_id, k // 144 AS day FROM m),
g AS (SELECT station_id, day * 144 + i AS k FROM d, range(144) t(i))
SELECT station_id, strftime(make_timestamp(k * 600000000), '%Y-%m-%dT%H:%M:%SZ') AS slot_utc
FROM g ANTI JOIN m USING (station_id, k)
"""

ORACLES["p1_emissions"] = f"""
WITH {_RAIN},
k AS (SELECT *, greatest(epoch_us(arr) + ((-epoch_us(arr)) % 600000000 + 600000000) % 600000000, epoch_us(h) + 4200000000) AS pub FROM r WHERE arr <= h + INTERVAL 25 HOUR),
e AS (SELECT DISTINCT station_id, h, pub FROM k),
v AS (SELECT e.station_id, e.h, e.pub, k.observed_utc, arg_max(k.a, (k.arr, k.obs_id)) AS a FROM e JOIN k ON k.station_id = e.station_id AND k.h = e.h AND k.pub <= e.pub GROUP BY 1, 2, 3, 4),
s AS (SELECT station_id, h, pub, count(*) AS n, CAST(sum(a) AS BIGINT) AS t FROM v GROUP BY 1, 2, 3),
p AS (SELECT *, lag(n) OVER o AS pn, lag(t) OVER o AS pt FROM s WINDOW o AS (PARTITION BY station_id, h ORDER BY pub)),
q AS (SELECT * FROM p WHERE pn IS NULL OR pn <> n OR pt <> t)
SELECT station_id, strftime(CAST(h AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS hour_utc, pub AS emitted_us, n, t AS tenths_mm,
       CAST(sum(CASE WHEN pub > epoch_us(h) + 4200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, h ORDER BY pub) AS INTEGER) AS revision FROM q
"""

_VERSIONS = """
r AS (SELECT *, CASE WHEN len(coordinates) = 2 AND coordinates[1] IS NOT NULL AND coordinates[2] IS NOT NULL THEN coordinates END AS c FROM station_snapshots WHERE station_id IS NOT NULL AND valid_from IS NOT NULL),
h AS (SELECT station_id, valid_from, arg_max(station_height, (fetched_utc, snapshot_id)) FILTER (station_height IS NOT NULL AND NOT isnan(station_height)) AS h, arg_max(c, (fetched_utc, snapshot_id)) FILTER (c IS NOT NULL) AS c FROM r GROUP BY 1, 2),
f AS (SELECT station_id, valid_from, last_value(h IGNORE NULLS) OVER w AS h, last_value(least(c[1], c[2]) IGNORE NULLS) OVER w AS lon, last_value(greatest(c[1], c[2]) IGNORE NULLS) OVER w AS lat FROM h WINDOW w AS (PARTITION BY station_id ORDER BY valid_from)),
l AS (SELECT *, lag(h) OVER w AS ph, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM f WINDOW w AS (PARTITION BY station_id ORDER BY valid_from)),
m AS (SELECT *, coalesce(abs(h - ph) >= 0.25, false) OR coalesce(12742017.6 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(lon - plon) / 2), 2))) >= 50, false) AS changed FROM l)"""
_AT = lambda c: f"strftime(CAST({c} AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ')"
ORACLES["p2_found"] = f"WITH {_VERSIONS} SELECT station_id, {_AT('valid_from')} AS valid_from FROM m WHERE changed"
ORACLES["p2_history"] = f"""
WITH {_VERSIONS}, i AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY valid_from) + 1 AS version FROM m),
g AS (SELECT station_id, version, min(valid_from) AS a, arg_min(h, valid_from) FILTER (h IS NOT NULL) AS height, arg_min(lon, valid_from) FILTER (lon IS NOT NULL) AS lon, arg_min(lat, valid_from) FILTER (lat IS NOT NULL) AS lat, count(*) AS n_versions FROM i GROUP BY 1, 2)
SELECT station_id, CAST(version AS INTEGER) AS version, {_AT('a')} AS valid_from, {_AT('lead(a) OVER (PARTITION BY station_id ORDER BY a)')} AS valid_to, height, lon, lat, n_versions FROM g
"""

_POINTS = """
c AS (SELECT DISTINCT point_id, lat, lon FROM calibration_corpus WHERE point_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)),
pt AS (SELECT DISTINCT point_id, CASE WHEN t THEN lon ELSE lat END AS lat, CASE WHEN t THEN lat ELSE lon END AS lon FROM (SELECT *, NOT (lat BETWEEN 45 AND 70 AND lon BETWEEN 0 AND 30) AND lon BETWEEN 45 AND 70 AND lat BETWEEN 0 AND 30 AS t FROM c))"""
_EDGES = """
rg AS (SELECT region, ring_no, ring_lon AS x, ring_lat AS y, unnest(range(1, len(ring_lon) + 1)) AS i FROM region_areas WHERE region IS NOT NULL),
ed AS (SELECT region, x[i] AS ax, y[i] AS ay, x[i % len(x) + 1] AS bx, y[i % len(y) + 1] AS by_ FROM rg)"""
_KM = lambda a, b: f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_INSIDE = """
io AS (SELECT pt.point_id, pt.lat, pt.lon, ed.region FROM pt JOIN ed ON (ed.ay > pt.lat) <> (ed.by_ > pt.lat) AND pt.lon < (ed.bx - ed.ax) * (pt.lat - ed.ay) / (ed.by_ - ed.ay) + ed.ax GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)"""
_STATIONS = "sa AS (SELECT station_id, lat, lon FROM station_catalogue WHERE operation_to IS NULL AND station_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon))"
ORACLES["p6_found"] = f"""
WITH {_POINTS}, {_EDGES}, {_INSIDE}, {_STATIONS}
SELECT DISTINCT point_id, 'station' AS found_kind, station_id AS found_id FROM pt JOIN sa ON {_KM("pt", "sa")} <= 5 UNION SELECT DISTINCT point_id, 'region', region FROM io
"""
ORACLES["p6_pairs"] = f"""
WITH {_POINTS}, {_EDGES}, {_INSIDE}, {_STATIONS}
SELECT point_id, 'station' AS found_kind, station_id AS found_id, round({_KM("pt", "sa")}, 6) AS km FROM pt JOIN sa ON {_KM("pt", "sa")} <= 5 UNION ALL SELECT point_id, 'region', region, NULL FROM io
"""
