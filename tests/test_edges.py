"""Operators at their edges: empty tables, nulls in any column, ties, repeated rows, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from slotweave.operators import calibration, features, gauge, harmonise, lightning, matching, spatial
from slotweave.operators import verification as V
from slotweave.sources import geojson, store

MIN = 60_000_000
T0 = 1_780_000_200_000_000  # a full ten minutes
OBS = "station_id string, parameter_id string, value double, observed_utc timestamp, day int, slot_us string, m string, x int"


def obs(spark, rows):
    df = spark.createDataFrame([(s, p, v, None if k is None else T0 + k * MIN) for s, p, v, k in rows], "station_id string, parameter_id string, value double, us long")
    return df.select("station_id", "parameter_id", "value", F.timestamp_micros("us").alias("observed_utc"), F.lit(1).alias("day"), F.lit("y").alias("slot_us"), F.lit("z").alias("m"), F.lit(2).alias("x"))


def test_slots_of_odd_readings(spark):
    p = "precip_past10min"
    rows = [("a", p, 0.0, 0), ("a", p, -0.1, 10), ("a", p, None, 20), ("a", p, float("nan"), 30), ("a", "precip_dur_past10min", 3.0, 40), ("a", p, 0.5, 55), ("a", p, 0.5, 55), ("a", p, 0.7, 60), (None, p, 1.0, 0), ("a", p, 1.0, None), ("b", "temp_dry", 1.0, 0), ("c", None, 1.0, 0)]
    got = {((r.slot_us - T0) // MIN): (r.mm, r.wet) for r in gauge.slot_amounts(obs(spark, rows)).collect()}
    assert got == {0: (0.0, False), 10: (0.0, False), 20: (None, None), 30: (None, None), 40: (None, True), 50: (None, None), 60: (0.7, True)}
    pad = gauge.slot_amounts(obs(spark, rows), after_min=370).agg(F.max("slot_us")).first()[0]
    assert (pad - T0) // MIN == 430
    none = gauge.slot_amounts(obs(spark, rows).where("false"))
    assert none.count() == 0 and gauge.onsets(none).count() == 0 and gauge.trailing_features(none).count() == 0


def test_onsets_and_features_by_hand(spark):
    p = "precip_past10min"
    depth = [0.0] * 7 + [0.1, 0.2] + [0.0] * 6 + [0.3] + [None] * 3 + [0.0] * 6 + [0.1, 0.0]
    s = gauge.slot_amounts(obs(spark, [("a", p, v, 10 * k) for k, v in enumerate(depth)])).cache()
    assert sorted((r.onset_us - T0) // MIN // 10 for r in gauge.onsets(s).collect()) == [7, 15]
    d = spark.createDataFrame([(1, "a", T0 + 95 * MIN), (2, "a", T0 + 5 * MIN), (3, "b", T0), (4, "a", T0 - 90 * MIN), (5, "a", T0 + 185 * MIN), (6, None, T0), (7, "a", None)], "i int, station_id string, t long")
    f = {r.i: r for r in gauge.features_at(d, s, station="station_id", at_us="t", row_id=["i"]).collect()}
    assert len(f) == 7 and f[1].g_mm_10 == pytest.approx(0.2) and f[1].g_mm_30 == pytest.approx(0.3) and f[1].g_dry_60 == 0 and f[1].g_min_since_wet == 15
    assert f[2].g_known == 0 and f[3].g_mm_60 is None and f[4].g_known == 0 and f[5].g_mm_10 is None and f[5].g_min_since_wet == 35 and f[6].g_known == f[7].g_known == 0


def test_runs_and_lookups_of_nothing(spark):
    w = spark.createDataFrame([("a", 1, None), (None, 2, 5)], "station_id string, i int, t long")
    assert gauge.coverage_runs(w, "station_id", F.col("t")).count() == 0
    r = spark.createDataFrame([], "station_id string, r long, v double")
    left = spark.createDataFrame([("a", 1, T0), ("a", 1, T0)], "station_id string, i int, t long")
    a = dict(key="station_id", left_us="t", right_us="r", value="v", row_id=["i"], within_min=60)
    assert [tuple(x) for x in gauge.as_of(left, r, **a).collect()] == [(1, None, None)]
    assert [tuple(x) for x in features.nearest_within(left, r, **a).collect()] == [(1, None, None)]


def test_the_rule_on_nothing_and_on_gaps(spark):
    d = spark.createDataFrame([("a", 0, 1, 0.9, False), ("a", 10 * MIN, 2, None, False), ("a", 20 * MIN, 3, float("nan"), None), ("a", 20 * MIN, 4, 0.9, False), ("a", 600 * MIN, 5, 0.9, True), (None, 0, 6, 0.9, False), ("a", None, 7, 0.9, False)], "station_id string, us long, row_id long, p double, raining boolean")
    got = [(r.row_id, r.run, r.action) for r in matching.replay(d, thresholds=[50]).orderBy("us").collect()]
    assert got == [(1, 0, "notify"), (5, 1, "already_raining")]
    t = matching.replay(d, thresholds=[50], traced=True).orderBy("us", "row_id").collect()
    assert [r.row_id for r in t] == [1, 2, 3, 4, 5] and not t[0].armed
    assert matching.replay(d.where("false"), thresholds=[50]).count() == 0 and matching.pushes(matching.replay(d, thresholds=[50])).count() == 1


def test_scores_of_nothing(spark):
    v = spark.createDataFrame([], "g string, p double, y double, w double")
    assert V.reliability(v, ["g"]).count() == V.murphy(v, ["g"]).count() == V.ranking(v, ["g"]).count() == V.quantiles(v, ["g"], "p", [0.5]).count() == 0
    assert calibration.isotonic(v, ["g"]).count() == 0 and calibration.apply_curve(v, calibration.isotonic(v, ["g"]), ["g"]).count() == 0
    one = spark.createDataFrame([(None, 0.5, 1.0, 2.0), (None, None, 1.0, 1.0)], "g string, p double, y double, w double")
    c = calibration.apply_curve(one, calibration.isotonic(one.where("p is not null"), ["g"]), ["g"]).collect()
    assert sorted((r.p is None, r.calibrated) for r in c) == [(False, 1.0), (True, None)]


def test_strikes_around_nothing(spark):
    s = spark.createDataFrame([(1, 55.0, 10.0, T0), (2, None, 10.0, T0), (3, 55.0, 10.0, None), (4, 55.01, 10.0, T0 + MIN), (5, 55.01, 10.0, T0 + MIN)], "id long, lat double, lon double, us long")
    t = spark.createDataFrame([("t", 55.1, 10.0), ("n", None, 1.0)], "target string, lat double, lon double")
    near = lightning.around(s, t, stride_min=60, buffer_min=60, least=3)
    assert sorted(r.id for r in near.collect()) == [1, 4, 5]
    m = lightning.motion(lightning.cells(near))
    assert [(r.size, r.cell, r.speed_kmh) for r in m.collect()] == [(3, 1, None)]
    o = lightning.outlook(m, [3.0, 10.0]).first()
    assert (o.state, o.any_state, o.eta_3, o.eta_10) == ("stalled", "stalled", None, None)
    none = lightning.around(s.where("false"), t, stride_min=60, buffer_min=60)
    assert lightning.outlook(lightning.motion(lightning.cells(none)), [3.0]).count() == 0
    two = lightning.around(s, t, stride_min=30, buffer_min=60, least=2).select("at_us").distinct().count()
    assert two == 2  # overlapping buffers


def test_entry_into_a_ring(spark):
    d = spark.createDataFrame([(20.0, 0.0, -1.0, 0.0), (5.0, 0.0, 1.0, 0.0), (20.0, 0.0, 1.0, 0.0), (20.0, 30.0, -1.0, 0.0), (20.0, 0.0, 0.0, 0.0), (20.0, 0.0, None, None)], "e double, n double, ve double, vn double")
    assert [r[0] for r in d.select(lightning.entry_min(F.col("e"), F.col("n"), F.col("ve"), F.col("vn"), 10.0)).collect()] == [10.0, 0.0, None, None, None, None]


def test_places_of_one_group_only(spark):
    p = spark.createDataFrame([("a", 55.0, 10.0, "x"), ("b", 55.0, 10.0, "x"), ("c", 55.0, 10.0, "y"), ("d", 55.0, 10.0, None)], "id string, lat double, lon double, g string")
    assert sorted((r.g, r.a, r.b) for r in spatial.near_pairs(p, "id", 5.0, "g").collect()) == [("x", "a", "b"), ("x", "b", "a")]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = obs(spark, [("a", "p", float(k), 60 * k) for k in range(72)] + [("b", "q", 1.0, 0)]).drop("day").withColumn("day", F.to_date("observed_utc"))
    store.append_idempotent(spark, path, rows, ["station_id", "observed_utc", "parameter_id"], [F.col("value")], "day")
    store.append_idempotent(spark, path, rows, ["station_id", "observed_utc", "parameter_id"], [F.col("value")], "day")
    assert spark.read.parquet(path).count() == 73
    iso = lambda k: spark.range(1).select(F.date_format(F.timestamp_micros(F.lit(T0 + k * 60 * MIN)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    w = store.read_window(spark, path, iso(10), iso(40), parameters=["p"], stations=["a"])
    assert sorted(r.value for r in w.collect()) == [float(k) for k in range(10, 41)]
    assert "PartitionFilters: [isnotnull(day" in w._jdf.queryExecution().toString() and store.read_window(spark, path, iso(10), iso(40), stations=["z"]).count() == 0
    s = store.partition_spans(spark, path).collect()
    assert sum(r.n for r in s) == 73 and all(r.last_us - r.first_us == 86400 * 10**6 for r in s)
    a, b = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, t int"), spark.createDataFrame([(1, 7.0, 0)], "k int, n double, t int")
    assert {tuple(r) for r in store.last_table_wins([a, b], ["k"], [F.col("t")]).select("k", "v", "n").collect()} == {(1, None, 7.0), (2, "z", None)}
    long = spark.createDataFrame([("e", 10, 0.1), ("e", 10, 0.3), ("e", 30, None), ("f", 30, 0.2), ("f", 99, 0.9)], "e string, lead int, p double")
    wide = store.to_wide(long, ["e"], "lead", "p", [10, 30])
    assert store.lead_columns(wide.columns) == {10: "p_rain_10", 30: "p_rain_30"}
    assert {tuple(r) for r in store.to_long(wide, ["e"], "lead", "p").collect()} == {("e", 10, 0.3), ("f", 30, 0.2)}
    assert {r.e for r in store.newest(long, "e", 1, ["e"]).collect()} == {"e", "f"} and {r.e for r in store.newest(long, "e", 1).collect()} == {"f"}
    tags = spark.createDataFrame([(["u"],), (None,)], "t array<string>")
    assert [r.tag_u for r in store.with_flags(tags, "t", ["u"]).collect()] == [True, False]


def test_station_features_keep_their_reason(spark):
    raw = spark.createDataFrame([("{",), ('{"properties":{"name":"x"}}',), ('{"properties":{"stationId":"1","operationFrom":"2020-01-01T00:00:00"}}',), ('{"geometry":{"coordinates":[10.0,55.0]},"properties":{"stationId":"1","operationFrom":"2020-01-01T00:00:00Z"}}',)], "feature string")
    got = sorted((r.reason, r.operation_from is None) for r in geojson.parse_stations(raw).collect())
    assert got == [("no position", True), ("no station", True), ("not json", True), ("ok", False)]


def test_histograms_of_nothing(spark):
    d = spark.createDataFrame([], "g string, a double, b double")
    assert harmonise.histogram(d, ["g"], ["a", "b"], 0.0, 1.0, 5).count() == 0
