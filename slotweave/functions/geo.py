"""Geographic column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = EARTH_KM) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius_km) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first to the second position, 0 = north, clockwise."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def east_north_km(lat: Column, lon: Column, lat0: Column, lon0: Column, radius_km: float = EARTH_KM) -> tuple[Column, Column]:
    """Local plane coordinates around an origin."""
    return (F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius_km, F.radians(lat - lat0) * radius_km)


#: Positions of the network's radars (lat, lon).
RADARS = ((55.1731, 8.5520), (57.4893, 10.1361), (55.3262, 12.4493), (56.0240, 10.0246), (55.1127, 14.8875))
#: Bands of distance to the nearest radar (below so many km).
RADAR_BANDS = ((60.0, "0-60km"), (90.0, "60-90km"), (120.0, "90-120km"))
#: Boxes of regions (lat from, to, lon from, to); the first that holds a point wins.
REGION_BOXES = (
    ("Bornholm", 54.90, 55.35, 14.50, 15.30), ("Hovedstaden", 55.50, 56.15, 11.90, 12.75), ("Sjælland", 54.50, 56.05, 10.85, 12.70), ("Nordjylland", 56.60, 57.80, 8.00, 11.65),
    ("Sønderjylland", 54.55, 55.15, 8.00, 10.10), ("Fyn", 54.60, 55.65, 9.72, 10.90), ("Sydjylland", 55.15, 55.95, 8.00, 10.90), ("Midtjylland", 55.95, 56.60, 8.00, 11.60),
)


def nearest_radar_km(lat: Column, lon: Column) -> Column:
    return F.least(*[haversine_km(F.lit(a), F.lit(o), lat, lon) for a, o in RADARS])


def radar_band(km: Column) -> Column:
    """Band of distance; unknown distances fall in the last one."""
    out = F.when(km.isNull() | F.isnan(km), ">120km")
    for edge, name in RADAR_BANDS:
        out = out.when(km < edge, name)
    return out.otherwise(">120km")


def region_box(lat: Column, lon: Column) -> Column:
    out = F.when(lat.isNull() | lon.isNull(), F.lit(None))
    for name, a, b, c, d in REGION_BOXES:
        out = out.when(lat.between(a, b) & lon.between(c, d), name)
    return out.otherwise("Other")


def stereographic(lat: Column, lon: Column, lat_ts: float = 56.0, lon0: float = 10.0, radius_m: float = 6371000.0) -> tuple[Column, Column]:
    """Polar stereographic plane (sphere), true to scale at ``lat_ts``: x east and y north, in metres."""
    k = radius_m * (1 + math.sin(math.radians(lat_ts)))
    rho = F.lit(k) * F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2)
    lam = F.radians(lon - lon0)
    return rho * F.sin(lam), -rho * F.cos(lam)


def from_stereographic(x: Column, y: Column, lat_ts: float = 56.0, lon0: float = 10.0, radius_m: float = 6371000.0) -> tuple[Column, Column]:
    """(lat, lon) of plane coordinates."""
    k = radius_m * (1 + math.sin(math.radians(lat_ts)))
    rho = F.sqrt(x * x + y * y)
    return F.degrees(F.lit(math.pi / 2) - 2 * F.atan(rho / F.lit(k))), F.lit(lon0) + F.degrees(F.atan2(x, -y))


def local_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(east, north) offsets by fixed lengths of a degree, as the cell tracking uses them."""
    return (lon - lon0) * 111.320 * F.cos(F.radians(lat0)), (lat - lat0) * 110.574
