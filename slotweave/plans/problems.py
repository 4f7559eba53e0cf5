"""Registered queries of the data-pipeline problems 1, 2, 3, 5 and 6 (the others are optional, see the subpackage of text operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions.timeexpr import iso_utc, iso_utc_us
from slotweave.operators import history, late_panes, regular_grid, spatial, spikes
from slotweave.runtime import table

#: Fixed values of problem 1: first publication and cut-off after an hour's end, in minutes.
FIRST_WAIT, CUTOFF = 10, 24 * 60
#: Minutes of arrival that one partial takes together; both waits and the hour are multiples of it.
TICK = 10
#: Fixed values of problem 2.
HEIGHT_M, PLACE_M = 0.25, 50.0
#: The network's extent (degrees), by which a pair written as [lat, lon] is known.
LON_RANGE, LAT_RANGE = (0.0, 30.0), (45.0, 70.0)
STATION_KM = 5.0


def rain(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "observations").where(F.col("parameter_id") == "precip_past10min")


def tenths(value: str = "value"):
    """Rain in whole tenths of a millimetre; negative (trace) is 0, NaN is null."""
    v = F.col(value).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.round(F.greatest(v, F.lit(0.0)) * 10)).cast("long")


def rain_partials(spark: SparkSession, base: str, panes: int = 1) -> DataFrame:
    """Partials of hourly panes per ten minutes of arrival, up to the cut-off of the last window of ``panes`` panes over them."""
    return late_panes.pane_partials(
        rain(spark, base), keys=["station_id"], event="observed_utc", arrival=F.col("created_utc"), amount=tenths(), order="obs_id", pane_min=60, panes=panes, cutoff_min=CUTOFF, tick_min=TICK
    )


def rain_emissions(spark: SparkSession, base: str) -> DataFrame:
    return late_panes.emissions(rain_partials(spark, base), keys=["station_id"], first_wait_min=FIRST_WAIT, cutoff_min=CUTOFF)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Hours whose last publication differs from the first."""
    r = late_panes.corrected(rain_emissions(spark, base), keys=["station_id"])
    return r.select("station_id", iso_utc_us(F.col("window_us")).alias("hour_utc"))


def p1_emissions(spark: SparkSession, base: str) -> DataFrame:
    """Every published result of every station-hour, first and corrected."""
    e = rain_emissions(spark, base)
    return e.select("station_id", iso_utc_us(F.col("window_us")).alias("hour_utc"), F.col("emitted_us"), F.col("n"), F.col("amount").alias("tenths_mm"), F.col("revision").cast("int").alias("revision"))


def p1_sliding(spark: SparkSession, base: str) -> DataFrame:
    """Three-hour windows sliding by the hour, composed of hourly panes: as first published and at the cut-off."""
    r = late_panes.results_at(rain_partials(spark, base, 3), keys=["station_id"], waits_min=[FIRST_WAIT, CUTOFF], panes=3)
    r = r.where(F.col(f"count_{CUTOFF}") > 0)  # windows that ended before any of their readings came have no row
    return r.select("station_id", iso_utc_us(F.col("window_us")).alias("window_utc"), F.col(f"count_{FIRST_WAIT}").alias("n_first"), F.col(f"amount_{FIRST_WAIT}").alias("tenths_first"), F.col(f"count_{CUTOFF}").alias("n_last"), F.col(f"amount_{CUTOFF}").alias("tenths_last"))


def station_versions(spark: SparkSession, base: str) -> DataFrame:
    h = F.col("station_height")
    versions = history.last_known(
        table(spark, base, "station_snapshots"), entity="station_id", effective="valid_from", fetched="fetched_utc", tie="snapshot_id",
        attributes={"height": F.when(~F.isnan(h), h), "place": history.lon_lat(F.col("coordinates"), LON_RANGE, LAT_RANGE)},
    )
    return history.mark_changes(versions, attributes=["height", "place"], same={"height": history.same_number(HEIGHT_M), "place": history.same_place(PLACE_M)})


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Begins of all versions but a station's first."""
    i = history.islands(station_versions(spark, base), attributes=["height", "place"])
    return i.where("island > 1").select(F.col("entity").alias("station_id"), iso_utc(F.col("valid_from")).alias("valid_from"))


def p2_history(spark: SparkSession, base: str) -> DataFrame:
    """Each station's versions with their validity."""
    i = history.islands(station_versions(spark, base), attributes=["height", "place"])
    return i.select(F.col("entity").alias("station_id"), F.col("island").cast("int").alias("version"), iso_utc(F.col("valid_from")).alias("valid_from"), iso_utc(F.col("valid_to")).alias("valid_to"), "height", F.col("place.lon").alias("lon"), F.col("place.lat").alias("lat"), "n_versions")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return spikes.flag_faults(table(spark, base, "observations")).select("obs_id")


def p3_flags(spark: SparkSession, base: str) -> DataFrame:
    """Faulty rows with the reason."""
    return spikes.flag_faults(table(spark, base, "observations"))


def rain_series(spark: SparkSession, base: str) -> DataFrame:
    rows = rain(spark, base).withColumn("value", F.when(F.col("value") < 0, F.lit(0.0)).otherwise(F.col("value").cast("double")))
    rows = rows.withColumn("arrived", F.coalesce("created_utc", "observed_utc"))
    return regular_grid.regular_series(rows, source="station_id", ts="observed_utc", value="value", order=["arrived", "obs_id"], floor=0.0)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The marks that had to be filled."""
    return rain_series(spark, base).where("status = 'missing' and filled is not null").select(F.col("source").alias("station_id"), iso_utc_us(F.col("slot_us")).alias("slot_utc"))


def p5_series(spark: SparkSession, base: str) -> DataFrame:
    """The whole ten-minute series, observed and filled."""
    return rain_series(spark, base).select(F.col("source").alias("station_id"), iso_utc_us(F.col("slot_us")).alias("slot_utc"), "value", F.round("filled", 6).alias("filled"), "status")


def corpus_points(spark: SparkSession, base: str) -> DataFrame:
    """The positions of the corpus points: exchanged coordinates put right, each position once."""
    c = table(spark, base, "calibration_corpus").select("point_id", "lat", "lon").distinct()
    right = F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE)
    turned = ~right & F.col("lon").between(*LAT_RANGE) & F.col("lat").between(*LON_RANGE)
    return c.select("point_id", F.when(turned, F.col("lon")).otherwise(F.col("lat")).alias("lat"), F.when(turned, F.col("lat")).otherwise(F.col("lon")).alias("lon"))


def sites(spark: SparkSession, base: str, km: float = STATION_KM) -> DataFrame:
    """Present stations as circles and regions (outer rings and holes together) as areas."""
    ring = "array<array<double>>"
    st = table(spark, base, "station_catalogue").where("operation_to is null and station_id is not null")
    st = st.select(F.lit("station").alias("kind"), F.col("station_id").alias("id"), "lat", "lon", F.lit(km).alias("km"), F.lit(None).cast(ring).alias("rings_lon"), F.lit(None).cast(ring).alias("rings_lat"))
    none = F.lit(None).cast("double")
    rings = table(spark, base, "region_areas").where("region is not null").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("ring_no", "ring_lon", "ring_lat"))).alias("r"))
    return st.unionByName(rings.select(F.lit("region").alias("kind"), F.col("region").alias("id"), none.alias("lat"), none.alias("lon"), none.alias("km"), F.col("r.ring_lon").alias("rings_lon"), F.col("r.ring_lat").alias("rings_lat")))


def p6_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Points with stations within reach (with the distance) and containing regions."""
    return spatial.match_sites(corpus_points(spark, base), sites(spark, base)).withColumn("km", F.round("km", 6))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_pairs(spark, base).select("point_id", "found_kind", "found_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_emissions, p1_sliding, p2_found, p2_history, p3_found, p3_flags, p5_found, p5_series, p6_found, p6_pairs)}
