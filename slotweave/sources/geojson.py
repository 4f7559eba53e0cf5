"""GeoJSON observation features to readings, bad ones kept with their reason; and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURE = "struct<geometry:struct<coordinates:array<double>>, properties:struct<parameterId:string, created:string, value:double, observed:string, stationId:string>>"


def write_observations(obs: DataFrame) -> DataFrame:
    """One column ``feature``: each reading as a GeoJSON feature."""
    iso = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    props = F.struct(F.col("parameter_id").alias("parameterId"), iso("created_utc").alias("created"), F.col("value").cast("double").alias("value"), iso("observed_utc").alias("observed"), F.col("station_id").alias("stationId"))
    return obs.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"))).alias("feature"))


def parse_observations(raw: DataFrame, column: str = "feature") -> DataFrame:
    """``station_id, observed_utc, parameter_id, value, created_utc, reason``.

    ``reason`` is ``ok``, ``ok, no created``, ``no value``, or why a feature cannot be used (``not json``, ``no station``, ``no time``,
    ``no parameter``); nothing is dropped here. Negative amounts stay as they are.
    """
    p = F.from_json(F.col(column), FEATURE)["properties"]
    t = lambda c: F.try_to_timestamp(c)
    d = raw.select(p["stationId"].alias("station_id"), t(p["observed"]).alias("observed_utc"), p["parameterId"].alias("parameter_id"), p["value"].cast("float").alias("value"), t(p["created"]).alias("created_utc"), p.isNull().alias("__bad"))
    reason = (
        F.when(F.col("__bad"), "not json").when(F.col("station_id").isNull(), "no station").when(F.col("observed_utc").isNull(), "no time").when(F.col("parameter_id").isNull(), "no parameter")
        .when(F.col("value").isNull(), "no value").when(F.col("created_utc").isNull(), "ok, no created").otherwise("ok")
    )
    return d.withColumn("reason", reason).drop("__bad")


STATION = "struct<geometry:struct<coordinates:array<double>>, properties:struct<stationId:string, name:string, status:string, country:string, operationFrom:string, operationTo:string, parameterId:array<string>>>"


def instant_of(text):
    """An instant with zone; null for anything else, a time without zone included."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def write_stations(stations: DataFrame) -> DataFrame:
    """One column ``feature``: each catalogue row as a GeoJSON feature."""
    iso = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.array("lon", "lat").alias("coordinates")))
    props = F.struct(F.col("station_id").alias("stationId"), "name", "status", "country", iso("operation_from").alias("operationFrom"), iso("operation_to").alias("operationTo"), F.col("parameter_ids").alias("parameterId"))
    return stations.select(F.to_json(F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), props.alias("properties"))).alias("feature"))


def parse_stations(raw: DataFrame, column: str = "feature") -> DataFrame:
    """``station_id, name, lat, lon, status, country, operation_from, operation_to, parameter_ids, reason``; nothing is dropped: ``reason`` is ``ok``, ``not json``, ``no station`` or ``no position``."""
    f = F.from_json(F.col(column), STATION)
    p, at = f["properties"], f["geometry"]["coordinates"]
    d = raw.select(
        p["stationId"].alias("station_id"), p["name"].alias("name"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), p["status"].alias("status"), p["country"].alias("country"),
        instant_of(p["operationFrom"]).alias("operation_from"), instant_of(p["operationTo"]).alias("operation_to"), p["parameterId"].alias("parameter_ids"), p.isNull().alias("__bad"),
    )
    reason = F.when(F.col("__bad"), "not json").when(F.col("station_id").isNull(), "no station").when(F.col("lat").isNull() | F.col("lon").isNull(), "no position").otherwise("ok")
    return d.withColumn("reason", reason).drop("__bad")
