"""Problems 1, 2, 3, 5 and 6 against brute force and at their edges: nulls, ties, repeats, empty tables, clashing columns."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.operators import history, late_panes, regular_grid, spatial, spikes
from slotweave.plans import problems

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 5, 1, tzinfo=UTC)
OBS = "obs_id long, station_id string, observed_utc timestamp, parameter_id string, value float, created_utc timestamp, pane_us string, window_us string, v int, block int, id string"


def obs(spark, data):
    """Readings (station, minutes, value, minutes of arrival), with columns whose names clash with inner ones."""
    at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    full = [(i, s, at(m), "precip_past10min", v, at(a), "x", "y", 1, 2, "z") for i, (s, m, v, a) in enumerate(data)]
    return spark.createDataFrame(full, OBS)


def partials(df, **k):
    return late_panes.pane_partials(df, keys=["station_id"], event="observed_utc", arrival=F.col("created_utc"), amount=problems.tenths(), order="obs_id", **k)


def brute_panes(data, wait):
    out = {}
    last = {}
    for i, (s, m, v, a) in enumerate(data):
        if s is None or m is None or v is None or v != v:
            continue
        arr = m if a is None else a
        if arr <= (m // 60) * 60 + 60 + wait:
            k = (s, m)
            if k not in last or last[k][:2] < (arr, i):
                last[k] = (arr, i, round(max(v, 0) * 10))
    for (s, m), (_, _, v) in last.items():
        n, t = out.get((s, m // 60), (0, 0))
        out[s, m // 60] = n + 1, t + v
    return out


def test_panes_match_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randrange(0, 400), rng.choice([None, float("nan"), -0.1, 0.0, 0.3, 1.2]), rng.choice([None, 50, 75, 400, 1500, 3000])) for _ in range(600)]
    r = late_panes.results_at(partials(obs(spark, data)), keys=["station_id"], waits_min=[10, 1440])
    got = {(x.station_id, int((x.window_us / 6e7 - T0.timestamp() / 60) // 60)): (x.count_10, x.amount_10, x.count_1440, x.amount_1440) for x in r.collect()}
    a, b = brute_panes(data, 10), brute_panes(data, 1440)
    assert {k: v for k, v in got.items() if any(v)} == {k: (*a.get(k, (0, 0)), *v) for k, v in b.items()}


def test_emissions_end_in_the_last_result(spark):
    data = [("a", 5, 1.0, 6), ("a", 15, 2.0, 200), ("a", 5, 1.5, 300), ("a", 5, 1.5, 400), ("a", 25, 1.0, 9999)]
    e = late_panes.emissions(partials(obs(spark, data)), keys=["station_id"], first_wait_min=10, cutoff_min=1440)
    assert [(x.n, x.amount, x.revision) for x in e.orderBy("emitted_us").collect()] == [(1, 10, 0), (2, 30, 1), (2, 35, 2)]
    assert [tuple(x)[2:] for x in late_panes.corrected(e, keys=["station_id"]).collect()] == [(1, 10, 2, 35)]


@pytest.mark.parametrize("panes", [1, 3])
def test_emissions_tell_the_same_as_the_results(spark, panes):
    rng = random.Random(8)
    data = [("a", rng.randrange(0, 300), round(rng.random(), 1), rng.choice([None, 80, 310, 700, 1500, 1590, 1700])) for _ in range(150)]
    p = partials(obs(spark, data), panes=panes, tick_min=10)
    r = {x.window_us: (x.count_10, x.amount_10, x.count_1440, x.amount_1440) for x in late_panes.results_at(p, keys=["station_id"], waits_min=[10, 1440], panes=panes).collect()}
    e = late_panes.emissions(p, keys=["station_id"], first_wait_min=10, cutoff_min=1440, panes=panes)
    c = {x.window_us: (x.n_first, x.amount_first, x.n_last, x.amount_last) for x in late_panes.corrected(e, keys=["station_id"]).collect()}
    assert c and c == {k: v for k, v in r.items() if v[:2] != v[2:]}


def test_a_late_change_recomposes_only_the_windows_over_its_pane(spark):
    data = [("a", 60 * h + 5, 1.0, 60 * h + 6) for h in range(8)]
    args = dict(keys=["station_id"], first_wait_min=10, cutoff_min=1440, panes=3)
    before = {tuple(r) for r in late_panes.emissions(partials(obs(spark, data), panes=3), **args).collect()}
    after = {tuple(r) for r in late_panes.emissions(partials(obs(spark, data + [("a", 60 * 4 + 25, 2.0, 900)]), panes=3), **args).collect()}
    new = after - before
    assert before <= after and {(r[1] / 6e7 - T0.timestamp() / 60) / 60 for r in new} == {2.0, 3.0, 4.0} and {r[5] for r in new} == {1}


def test_partials_hold_one_row_a_pane_and_tick(spark):
    data = [("a", m, 0.1, 71 + m % 3) for m in range(60)]
    assert partials(obs(spark, data), tick_min=10).count() == 1


def test_sliding_windows_recompose_only_their_panes(spark):
    w = late_panes.windows_of(partials(obs(spark, [("a", 65, 1.0, 70)])), panes=3)
    assert w.count() == 3 and w.select("window_us").distinct().count() == 3


def test_sliding_windows_wait_for_their_own_cutoff(spark, monkeypatch):
    data = [("a", 5, 1.0, 60 + 1440 + 30), ("a", 15, 2.0, 20), ("b", 5, 1.0, 60 + 1440 + 30), ("c", 5, 1.0, 180 + 1440), ("c", 6, 1.0, 180 + 1441)]
    monkeypatch.setattr(problems, "rain", lambda spark, base: obs(spark, data))
    got = {(r.station_id, r.window_utc[8:13]): (r.n_last, r.tenths_last) for r in problems.p1_sliding(spark, "").collect()}
    assert got == {("a", "30T22"): (1, 20), ("a", "30T23"): (2, 30), ("a", "01T00"): (2, 30), ("b", "30T23"): (1, 10), ("b", "01T00"): (1, 10), ("c", "01T00"): (1, 10)}


def test_empty_panes(spark):
    assert late_panes.results_at(partials(obs(spark, [])), keys=["station_id"], waits_min=[10]).count() == 0


SNAP = "snapshot_id long, fetched_utc timestamp, station_id string, coordinates array<double>, station_height double, valid_from timestamp, height string, place string, entity int"


def versions(spark, data):
    at = lambda d: None if d is None else T0 + dt.timedelta(days=d)
    df = spark.createDataFrame([(i, at(f), s, c, h, at(v), "x", "y", 1) for i, (f, s, c, h, v) in enumerate(data)], SNAP)
    h = F.col("station_height")
    last = history.last_known(df, entity="station_id", effective="valid_from", fetched="fetched_utc", tie="snapshot_id", attributes={"height": F.when(~F.isnan(h), h), "place": history.lon_lat(F.col("coordinates"), (0, 30), (45, 70))})
    return history.mark_changes(last, attributes=["height", "place"], same={"height": history.same_number(0.25), "place": history.same_place(50)})


def test_history_tolerances_swaps_and_order(spark):
    data = [
        (1, "a", [10.0, 55.0], 5.0, 0), (2, "a", [55.0, 10.0], 5.2, 1), (3, "a", [10.0, 55.001], 5.2, 2), (4, "a", None, 9.0, 3), (9, "a", None, None, 3),
        (5, "a", [10.0, 55.001], 9.0, 3), (8, "a", [11.0, 55.0], 1.0, None), (4, None, [1.0, 2.0], 1.0, 4), (7, "a", [None, 2.0], float("nan"), 5), (6, "b", None, None, 0), (1, "b", None, 3.0, 1), (2, "b", [10.0, 55.0], 4.0, 2),
    ]
    m = versions(spark, data)
    got = {(r.entity, (r.effective.replace(tzinfo=UTC) - T0).days) for r in m.where("changed").collect()}
    assert got == {("a", 2), ("a", 3), ("b", 2)}
    i = history.islands(m, attributes=["height", "place"]).orderBy("entity", "island").collect()
    assert [(x.entity, x.n_versions, x.valid_to is None) for x in i] == [("a", 2, False), ("a", 1, False), ("a", 2, True), ("b", 2, False), ("b", 1, True)]


def test_history_empty(spark):
    assert versions(spark, []).count() == 0


def series(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.95 * x[i - 1] + rng.normal(0, 0.3)
    return 12 + 3 * np.sin(np.arange(n) / 144 * 2 * math.pi) + x


def kinds_of(v, kind="temp_dry"):
    return spikes.judge(np.arange(len(v)) * 600_000_000, np.round(np.asarray(v, float), 1), spikes.KINDS[kind])


def test_spikes_are_told_from_shifts_and_fades():
    v = series()
    v[100] += 9
    v[200:203] -= 8
    v[300:] += 10
    v[400:440] += 8 * 0.85 ** np.arange(40)
    v[500] = -999.9
    r = kinds_of(v)
    assert set(np.flatnonzero(r == 3)) == {100, 200, 201, 202} and set(np.flatnonzero(r == 1)) == {500}


def test_stuck_runs_and_rain_rules():
    v = series(seed=1)
    v[50:75] = 11.3
    assert set(np.flatnonzero(kinds_of(v) == 2)) == set(range(50, 75))
    rain = np.zeros(400)
    rain[20:60] = 0.0
    rain[100:106] = [0.5, 2.0, 5.5, 7.0, 3.0, 0.8]
    rain[200], rain[250], rain[260], rain[300:330] = 25.0, -0.1, -9.9, 1.1
    r = kinds_of(rain, "precip_past10min")
    assert set(np.flatnonzero(r == 3)) == {200} and set(np.flatnonzero(r == 1)) == {260} and set(np.flatnonzero(r == 2)) == set(range(300, 330))
    assert not (kinds_of([10.0] * 40, "precip_dur_past10min") > 0).any()


def test_runs_hold_over_block_borders(spark):
    v = series(6000, seed=2)
    border = ((int(T0.timestamp()) // 86400 // 64 + 1) * 64 * 86400 - int(T0.timestamp())) // 600  # of two blocks
    assert border < 9000
    v[border - 20 : border + 20] = 9.9
    data = [(i, "s", T0 + dt.timedelta(minutes=10 * i), "temp_dry", float(np.round(x, 1)), None, "", "", 0, 0, "") for i, x in enumerate(v)]
    data += [(90001, None, T0, "temp_dry", 5.0, None, "", "", 0, 0, ""), (90002, "s", None, "temp_dry", 5.0, None, "", "", 0, 0, ""), (90003, "s", T0, "temp_dry", None, None, "", "", 0, 0, ""), (90004, "s", T0, "temp_dry", float("nan"), None, "", "", 0, 0, "")]
    got = {r.obs_id for r in spikes.flag_faults(spark.createDataFrame(data, OBS)).where("reason = 'stuck'").collect()}
    assert got == set(range(border - 20, border + 20))
    assert spikes.flag_faults(spark.createDataFrame([], OBS)).count() == 0


def test_repeats_count_by_their_own_value():
    us = np.array([0, 600, 600, 1200]) * 1_000_000
    assert spikes.longest_runs(us, np.array([1.0, 1.0, 5.0, 1.0]), 1e12).tolist() == [3, 3, 1, 3]


def grid(spark, data):
    return regular_grid.regular_series(obs(spark, data), source="station_id", ts="observed_utc", value="value", order=["created_utc", "obs_id"], floor=0.0)


def test_grid_fills_and_marks(spark):
    data = [("a", 10 * k + (3 if k % 2 else -3), 1.0 + k % 5, 10 * k + 11) for k in range(1, 300) if not 20 <= k < 40]
    data += [("a", 2000, None, 1), ("b", 5, 1.0, 1), ("b", 5, 2.0, 2), (None, 5, 1.0, 1), ("c", 5, float("nan"), 1)]
    g = grid(spark, data).collect()
    a = [r for r in g if r.source == "a"]
    assert len(a) == 3 * 144 and {r.status for r in a} == {"observed", "missing"}
    miss = {(r.slot_us - int(T0.timestamp() * 1e6)) // 600_000_000 for r in a if r.status == "missing"}
    assert miss == {0, *range(20, 40), *range(300, 432)}
    assert all(r.filled is not None and r.filled >= 0 for r in a)
    b = [r for r in g if r.source == "b" and r.value is not None]
    assert [(r.value, (r.slot_us // 600_000_000) % 144) for r in b] == [(2.0, 1)] and not [r for r in g if r.source == "c"]


def test_grid_bridges_between_the_ends(spark):
    data = [("a", 10 * k, 5.0 + math.cos(2 * math.pi * k / 144), 1) for k in range(0, 720) if not 300 <= k < 330]
    off = [abs(r.filled - 5 - math.cos(2 * math.pi * (r.slot_us // 600_000_000) / 144)) for r in grid(spark, data).where("status = 'missing'").collect()]
    assert len(off) == 30 and max(off) < 0.02


def test_grid_empty(spark):
    assert grid(spark, []).count() == 0


def brute_pairs(points, circles, rings):
    out = set()
    for pid, lat, lon in points:
        if lat is None or lon is None or lat != lat:
            continue
        for sid, a, b, km in circles:
            if spatial.km_between(np.array([lat]), np.array([lon]), a, b)[0] <= km:
                out.add((pid, "station", sid))
        if spatial.inside_rings(np.array([lon]), np.array([lat]), rings)[0]:
            out.add((pid, "region", "R"))
    return out


@pytest.mark.parametrize("cell_rows", [3, 50_000])
def test_sites_match_brute_force(spark, cell_rows):
    rng = random.Random(5)
    pts = [(f"p{i}", 55 + rng.random(), 10 + rng.random()) for i in range(300)] + [(f"h{i}", 55.5, 10.5) for i in range(200)]  # a hot place
    pts += [("n1", None, 10.0), ("n2", float("nan"), 10.0), ("p0", *pts[0][1:])]
    circles = [(f"s{i}", 55 + rng.random(), 10 + rng.random(), 9.0) for i in range(25)] + [("hot", 55.5, 10.5, 0.0)]
    outer, hole = ([10.2, 10.8, 10.8, 10.2], [55.2, 55.2, 55.8, 55.8]), ([10.4, 10.4, 10.55, 10.55, 10.4], [55.4, 55.6, 55.6, 55.4, 55.4])
    p = spark.createDataFrame([(*x, "c", 1.0) for x in pts], "point_id string, lat double, lon double, cell string, km double")
    sites = [("station", s, a, b, k, None, None) for s, a, b, k in circles] + [("region", "R", None, None, None, [outer[0], hole[0]], [outer[1], hole[1]]), ("station", "null", None, 1.0, 5.0, None, None), ("region", "none", None, None, None, [], [])]
    got = [(r.point_id, r.found_kind, r.found_id) for r in spatial.match_sites(p, spark.createDataFrame(sites, spatial.SITE), cell_rows=cell_rows).collect()]
    want = brute_pairs(pts, circles, [(np.array(a), np.array(b)) for a, b in (outer, hole)])
    assert len(got) == len(set(got)) and set(got) == want


def test_sites_empty(spark):
    p = spark.createDataFrame([], "point_id string, lat double, lon double")
    q = spark.createDataFrame([("a", 1.0, 2.0)], "point_id string, lat double, lon double")
    s = spark.createDataFrame([], spatial.SITE)
    assert spatial.match_sites(p, s).count() == 0 and spatial.match_sites(q, s).count() == 0


def test_rtree_finds_all():
    rng = np.random.default_rng(1)
    lo = rng.random((500, 2))
    boxes = np.column_stack([lo, lo + rng.random((500, 2)) * 0.05])
    x, y = rng.random(400), rng.random(400)
    p, q = spatial.RTree(boxes).probe(x, y)
    inside = (x[:, None] >= boxes[:, 0]) & (y[:, None] >= boxes[:, 1]) & (x[:, None] <= boxes[:, 2]) & (y[:, None] <= boxes[:, 3])
    assert set(zip(p.tolist(), q.tolist())) == set(zip(*[a.tolist() for a in np.nonzero(inside)]))


def test_fill_error_on_hidden_readings(spark):
    """Known readings hidden from the fit are filled better than by the source's mean."""
    rng = np.random.default_rng(3)
    k = np.arange(0, 144 * 20)
    v = 8 + 4 * np.cos(2 * math.pi * k / 144) + 0.01 * k / 144 + np.convolve(rng.normal(0, 0.3, len(k)), np.ones(12) / 12, "same")
    hidden = {i for s in rng.choice(len(k) - 20, 40, replace=False) for i in range(s, s + 12)}
    data = [("a", int(10 * i), float(v[i]), 1) for i in k if i not in hidden]
    got = {(r.slot_us - int(T0.timestamp() * 1e6)) // 600_000_000: r.filled for r in grid(spark, data).where("status = 'missing'").collect()}
    assert hidden <= set(got)
    off = np.array([got[i] - v[i] for i in sorted(hidden)])
    assert np.sqrt(np.mean(off**2)) < 0.2 < 0.1 * np.std(v) * 2


def test_slow_sensors_are_stuck_over_block_borders(spark):
    """Thirteen equal three-hourly values, most of them beyond the border of a block."""
    border = (int(T0.timestamp()) // 86400 // 64 + 1) * 64 * 86400 - int(T0.timestamp())
    v = np.round(series(400, seed=6), 1)
    first = border // 10800 - 11
    v[first : first + 13] = 7.7
    data = [(i, "s", T0 + dt.timedelta(hours=3 * i), "temp_dry", float(x), None, "", "", 0, 0, "") for i, x in enumerate(v)]
    got = {r.obs_id for r in spikes.flag_faults(spark.createDataFrame(data, OBS)).where("reason = 'stuck'").collect()}
    assert got == set(range(first, first + 13))


def test_circles_reach_over_the_meridian_and_areas_fill_cells(spark):
    rng = random.Random(9)
    pts = [(f"p{i}", rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179, 180)) for i in range(400)] + [("pole", 89.99, 77.0)]
    circles = [("c1", 0.0, 179.9, 60.0), ("c2", 0.3, -179.95, 40.0), ("c3", 89.995, -100.0, 5.0)]
    p = spark.createDataFrame(pts, "point_id string, lat double, lon double")
    box = ([179.2, 179.9, 179.9, 179.2], [-0.8, -0.8, 0.8, 0.8])
    sites = [("station", s, a, b, k, None, None) for s, a, b, k in circles] + [("region", "R", None, None, None, [box[0]], [box[1]])]
    for cell_rows in (4, 50_000):
        got = [(r.point_id, r.found_kind, r.found_id) for r in spatial.match_sites(p, spark.createDataFrame(sites, spatial.SITE), cell_rows=cell_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(pts, circles, [(np.array(box[0]), np.array(box[1]))]) and ("pole", "station", "c3") in got


def test_crowded_sites_are_dealt_to_groups(spark):
    pts = [(f"p{i}", 55.0 + i * 1e-4, 10.0) for i in range(40)]
    sites = [("station", f"s{i}", 55.0, 10.0, 1.0, None, None) for i in range(300)]
    p = spark.createDataFrame(pts, "point_id string, lat double, lon double")
    got = [(r.point_id, r.found_id) for r in spatial.match_sites(p, spark.createDataFrame(sites, spatial.SITE), cell_rows=20).collect()]
    want = {(a, f"s{i}") for a, lat, lon in pts for i in range(300) if spatial.km_between(np.array([lat]), np.array([lon]), 55.0, 10.0)[0] <= 1.0}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_source_is_fitted_over_all_its_blocks(spark):
    """A short block after a long outage is judged by the source's history, as the whole series would be."""
    v = np.round(series(2400, seed=4), 1)
    at = [*range(2400), *range(6000, 6010)]
    v = np.r_[v, np.round(series(10, seed=5), 1)]
    v[2403] += 12
    data = [(i, "s", T0 + dt.timedelta(minutes=10 * m), "temp_dry", float(x), None, "", "", 0, 0, "") for i, (m, x) in enumerate(zip(at, v))]
    data.append((9000, "s", T0 + dt.timedelta(minutes=10 * at[2407]), "temp_dry", float(v[2407] - 12), None, "", "", 0, 0, ""))
    got = {r.obs_id for r in spikes.flag_faults(spark.createDataFrame(data, OBS)).where("reason = 'spike'").collect()}
    assert got == {2403, 9000}
