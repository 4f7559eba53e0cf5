"""Queries that outgrew their limits on larger tables: what they read, hold and emit, on small cases."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slotweave.operators import lightning, tracking
from slotweave.plans import registry
from slotweave.streaming import pipelines
from tests.helpers import BASE, database, rows


def test_holdout_reads_its_table_once_and_orders_events_by_text(spark, tmp_path):
    """An event without time counts among the events but takes no place before the others."""
    ev = [None, "2026-05-01T00:00:00+00:00", "2026-05-01T00:10:00+00:00", "2026-05-02T00:00:00+00:00"]
    data = [(e, lead, 0.05 + 0.1 * k + 0.01 * lead / 5, (k + i) % 2, 1.0 + k) for i, e in enumerate(ev) for lead in (5, 10) for k in range(4)]
    cols = list(zip(*data))
    pq.write_table(pa.table({"event_time": pa.array(cols[0], pa.string()), "lead_min": pa.array(cols[1], pa.int32()), "raw_prob": pa.array(cols[2], pa.float32()), "outcome": pa.array(cols[3], pa.int8()), "sample_weight": pa.array(cols[4], pa.float64())}), tmp_path / "calibration_corpus.parquet")
    db = duckdb.connect()
    db.sql(f"create view calibration_corpus as select * from '{tmp_path}/calibration_corpus.parquet'")
    df = registry.QUERIES["calibration_holdout"](spark, str(tmp_path))
    assert rows(df.toArrow()) == rows(db.sql(registry.ORACLES["calibration_holdout"]).arrow().read_all())
    assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The smallest tables with every id of a warning given three times, at different stations and times."""
    to = tmp_path_factory.mktemp("repeated")
    w = pq.read_table(f"{BASE}/warnings_scored.parquet")
    pq.write_table(w.set_column(0, "warning_id", pa.array([None if x is None else x // 3 for x in w.column("warning_id").to_pylist()], pa.int64())), to / "warnings_scored.parquet")
    pq.write_table(pq.read_table(f"{BASE}/station_catalogue.parquet"), to / "station_catalogue.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["strike_backtest", "strike_entry", "strike_cells", "strike_outlook"])
def test_strikes_stay_apart_where_ids_repeat(spark, repeated, name):
    want = database(repeated).sql(registry.ORACLES[name]).arrow().read_all()
    assert want.num_rows and rows(registry.QUERIES[name](spark, repeated).toArrow()) == rows(want)


def test_targets_see_the_cells_of_the_pairwise_way(spark):
    """Over two bands of latitude, overlapping buffers, nulls and the 180th meridian."""
    r = np.random.default_rng(5)
    at = [(k, 56 + float(a), 10 + float(b), 1_780_000_000_000_000 + int(u)) for k, (a, b, u) in enumerate(zip(r.uniform(-1, 1, 120), r.uniform(-1, 1, 120), r.integers(0, 5_400_000_000, 120)))]
    at += [(k + 200, 10.0, 179.9 if k % 2 else -179.9, 1_780_000_000_000_000 + k) for k in range(6)] + [(300, None, 10.0, 5), (301, 56.0, 10.0, None), (None, 56.0, 10.0, 5), (302, float("nan"), 10.0, 5)]
    s = spark.createDataFrame(at, "id long, lat double, lon double, us long")
    t = spark.createDataFrame([("a", 56.0, 10.0), ("b", 56.3, 10.4), ("c", 55.2, 9.6), ("d", 10.0, 180.0), ("e", -80.0, 0.0), ("n", None, 1.0)], "target string, lat double, lon double")
    how = dict(stride_min=30, buffer_min=60, least=3)
    cols = ["target", "at_us", "cell", "n_strikes", "size", "clat", "clon", "spread_km", "age_min", "edge_km", "closing_kmh", "speed_kmh", "bearing", "ve", "vn", "confidence"]
    got = tracking.seen(s, t, **how).select("*", F.explode("cells").alias("c")).select("target", "at_us", "n_strikes", "c.*").select(cols)
    want = lightning.motion(lightning.cells(lightning.around(s, t, **how))).select(cols)
    key = lambda x: tuple(x)[:3]
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) > 20
    for a, b in zip(got, want):
        assert tuple(a)[:5] == tuple(b)[:5] and [x is None for x in a] == [x is None for x in b]
        assert [x for x in tuple(a)[5:] if x is not None] == pytest.approx([x for x in tuple(b)[5:] if x is not None], rel=1e-6, abs=1e-6)
    few = tracking.seen(s, t, **how, few=True).groupBy("target", "at_us", "n_strikes").agg(F.max("near_km").alias("km")).collect()
    near = lightning.around(s, t, stride_min=30, buffer_min=60, least=1).groupBy("target", "at_us").agg(F.count(F.lit(1)).alias("n"), F.min("km").alias("km")).collect()
    assert {(x.target, x.at_us, x.n_strikes, round(x.km, 6)) for x in few} == {(x.target, x.at_us, x.n, round(x.km, 6)) for x in near}
    assert tracking.seen(s.where("false"), t, **how).count() == tracking.seen(s, t.where("false"), **how).count() == 0


def test_links_do_not_hang_on_the_parts(monkeypatch):
    r = np.random.default_rng(6)
    ids, lat, lon = np.sort(r.integers(0, 60, 90)), 56 + r.uniform(-1, 1, 90), 10 + r.uniform(-1, 1, 90)
    pairs = lambda: {tuple(sorted(p)) for i, j in tracking.links(ids, lat, lon, 15.0) for p in zip(i.tolist(), j.tolist())}
    whole = pairs()
    monkeypatch.setattr(tracking, "PART", 7)
    d = tracking.km_between(lat[:, None], lon[:, None], lat[None], lon[None])
    assert pairs() == whole == {(i, j) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= 15 or ids[i] == ids[j]}
    f = tracking.united(np.arange(6), np.array([5, 1]), np.array([3, 4]))
    assert tracking.united(f, np.array([4]), np.array([5])).tolist() == [0, 1, 2, 1, 1, 1]


def test_live_panes_of_a_day_share_a_state(spark):
    """Every pane is emitted on its own, but there is one state a station and day."""
    t = 1_777_593_600_000_000  # midnight
    df = spark.range(60).select(F.col("id").alias("obs_id"), F.lit("a").alias("station_id"), F.timestamp_micros(F.lit(t) + F.col("id") * 1_800_000_000).alias("observed_utc"), F.lit("precip_past10min").alias("parameter_id"), F.lit(0.1).alias("value"))
    df = df.withColumn("created_utc", F.col("observed_utc"))
    seen = []
    e = pipelines.feed(df, F.unix_micros("created_utc"), pipelines.live_panes, parts=2, progress=seen)
    last = {r.pane_us: (r.n, r.amount) for r in e.orderBy("batch").collect()}
    assert last == {t + k * 3_600_000_000: (2, 2) for k in range(30)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in seen) <= 2
