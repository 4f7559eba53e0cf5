"""Column functions of rain, radar and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the reflectivity relation.
ZR_A, ZR_B, DBZ_CAP, RAIN_CAP = 200.0, 1.6, 53.0, 100.0


def rain_rate(dbz: Column) -> Column:
    """mm/h from dBZ, capped; NaN stays, minus infinity is 0."""
    r = F.least(F.pow(F.pow(F.lit(10.0), F.least(dbz, F.lit(DBZ_CAP)) / 10) / ZR_A, F.lit(1 / ZR_B)), F.lit(RAIN_CAP))
    return F.when(F.isnan(dbz), dbz).otherwise(r)


def reflectivity(mm_h: Column) -> Column:
    return F.when(mm_h > 0, 10 * F.log10(ZR_A * F.pow(mm_h, F.lit(ZR_B))))


def decibel(mm_h: Column, threshold: float = 0.1, zero: float = -15.0) -> Column:
    return F.when(mm_h < threshold, F.lit(zero)).otherwise(10 * F.log10(mm_h))


def from_decibel(db: Column, zero: float = -15.0) -> Column:
    """Inverse of ``decibel``: the zero value (and NaN) is no rain."""
    return F.when((db > zero + 1e-3) & ~F.isnan(db), F.pow(F.lit(10.0), db / 10)).when(db.isNotNull(), 0.0)


def quantise(x: Column, scale: float, offset: float) -> Column:
    """0..254 with halves to even; 255 for what is null or not finite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    level = F.bround((F.greatest(F.lit(offset), F.least(x, F.lit(offset + 254 * scale))) - offset) / scale)
    return F.when(bad, F.lit(255)).otherwise(level.cast("int"))


def dequantise(level: Column, scale: float, offset: float) -> Column:
    return F.when(level < 255, level * scale + offset)


def bearing_from(dy: Column, dx: Column) -> Column:
    """Where motion (rows down, columns right) comes from, in degrees, 0 = north; 0 without motion."""
    return F.when((dy == 0) & (dx == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0)))


def compass(deg: Column) -> Column:
    """One of eight points (halves to the even one)."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, F.pmod(F.bround(deg / 45).cast("int"), F.lit(8)))


#: Bands of rain rate (mm/h, from, below).
INTENSITY_BANDS = (("trace", 0.0, 0.5), ("light", 0.5, 1.0), ("moderate", 1.0, 4.0), ("heavy", 4.0, float("inf")))


def intensity_band(mm_h: Column) -> Column:
    out = F.when(mm_h.isNull() | F.isnan(mm_h) | (F.abs(mm_h) == F.lit(float("inf"))), "unknown")
    for name, low, high in INTENSITY_BANDS:
        out = out.when((mm_h >= low) & (mm_h < high), name)
    return out.otherwise("heavy")


def two_slot_rate(depth_mm: Column, slot_min: int = 10) -> Column:
    """Depth of two slots as a rate in mm/h."""
    return depth_mm * 60.0 / (2.0 * slot_min)


def dual_truth(gauge_wet: Column, radar_wet: Column) -> Column:
    """The verdict of two instruments; null if either said nothing."""
    return F.when(gauge_wet & radar_wet, "both_wet").when(radar_wet & ~gauge_wet, "radar_wet_gauge_dry").when(gauge_wet & ~radar_wet, "gauge_wet_radar_dry").when(~gauge_wet & ~radar_wet, "both_dry")


def round_to(x: Column, step: float) -> Column:
    """Nearest multiple, halves up."""
    return F.floor(x / step + 0.5) * step


def scan_type(minute: Column) -> Column:
    return F.when(minute % 10 == 0, "fullRange").when(minute % 10 == 5, "doppler").otherwise("unknown")


def in_quiet_hours(ts: Column, zone: str, start_min: int, end_min: int) -> Column:
    """Whether local clock time lies in the window, which may wrap over midnight."""
    local = F.from_utc_timestamp(ts, zone)
    m = F.hour(local) * 60 + F.minute(local)
    return (m >= start_min) & (m < end_min) if start_min <= end_min else (m >= start_min) | (m < end_min)


def volatility(before: Column, now: Column) -> Column:
    """Change between two frames' greatest rates, 0 to 1; 1 if either is unknown."""
    bad = before.isNull() | now.isNull() | F.isnan(before) | F.isnan(now)
    return F.when(bad, 1.0).otherwise(F.least(F.lit(1.0), F.abs(now - before) / F.greatest(before, now, F.lit(5.0))))


def confidence(horizon_min: Column, age_s: Column, volatility_: Column, divergence: Column, frames: Column) -> Column:
    """Product of the decays of horizon, age, volatility, divergence and number of frames."""
    down = lambda x, least: F.greatest(F.lit(least), 1 - x)
    return down(horizon_min / 90.0, 0.1) * down(age_s / 1800.0, 0.0) * down(volatility_, 0.0) * down(divergence * 5, 0.0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (frames - 1) / 4.0))
