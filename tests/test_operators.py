"""Sequential operators, calibration, keyed tables and streams against brute force."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from slotweave.functions.text import station_number
from slotweave.operators import blocks, calibration, ensemble, matching, spatial
from slotweave.operators import verification as V
from slotweave.operators.components import connected_components
from slotweave.sources import geojson, store
from slotweave.streaming import pipelines

MIN = 60_000_000


def score_brute(warnings, onsets, slots, runs, lead=30, tol=10, dry=60, useful=5):
    """Every outcome by the plain statement of the rules."""
    win, out = (lead + tol) * MIN, set()
    for s in {x[0] for x in warnings} | {x[0] for x in onsets}:
        known = {u for t, u, wet in slots if t == s and wet is not None}
        until = max(known, default=None)
        free, taken = sorted(o for t, o in onsets if t == s), {}
        for _, wid, t, eta, clear in sorted((x for x in warnings if x[0] == s), key=lambda x: (x[2], x[1])):
            k = next((o for o in free if t < o <= t + win), None)
            if k is not None:
                free.remove(k)
                taken[k] = (wid, t)
                verdict = "hit" if k - t >= useful * MIN else "late"
            elif until is not None and t + win > until:
                verdict = "pending"
            elif not all(u in known for u in range(-(-(t - dry * MIN + 1) // (10 * MIN)) * 10 * MIN, t + win + 1, 10 * MIN)):
                verdict = "unscorable"
            else:
                verdict = "false_alarm"
            grade = None if clear is None else verdict if verdict in ("pending", "unscorable") else "right" if verdict == "false_alarm" else "wrong" if clear < k else "after_onset"
            out.add((s, "warning", wid, k, verdict, None if k is None or eta is None else round(eta - (k - t) / MIN, 6), grade))
        for o in sorted(x for t, x in onsets if t == s):
            if o in taken:
                wid, t = taken[o]
                out.add((s, "onset", wid, o, "hit" if o - t >= useful * MIN else "miss_late", None, None))
            elif not any(a <= o <= b for t, a, b in runs if t == s):
                out.add((s, "onset", None, o, "uncovered", None, None))
            else:
                out.add((s, "onset", None, o, "pending" if until is not None and o + tol * MIN > until else "miss", None, None))
    return out


def test_scoring_gives_every_outcome(spark):
    rng = random.Random(1)
    w = [(rng.choice("ab"), i, rng.randrange(0, 30000) * MIN, rng.choice([None, 20.0]), None) for i in range(400)]
    w = [(s, i, t, e, t + rng.randrange(1, 60) * MIN if i % 3 == 0 else None) for s, i, t, e, _ in w] + [("c", 900, 5 * MIN, 1.0, None)]
    o = sorted({(rng.choice("ab"), rng.randrange(0, 3000) * 10 * MIN) for _ in range(150)})
    slots = [(s, k * 10 * MIN, None if rng.random() < 0.02 else False) for s in "ab" for k in range(2400)]
    runs = [("a", 0, 9000 * MIN), ("a", 12000 * MIN, 40000 * MIN), ("b", 5000 * MIN, 23000 * MIN)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    sent = df(w, "station_id string, warning_id long, t_us long, eta_min double, all_clear_us long")
    onsets = df(o, "station_id string, onset_us long")
    e = matching.score_warnings(sent, onsets, slots=df(slots, "station_id string, slot_us long, wet boolean"), runs=df(runs, "station_id string, from_us long, to_us long")).cache()
    got = {(r.station_id, r.side, r.warning_id, r.onset_us, r.outcome, None if r.lead_error_min is None else round(r.lead_error_min, 6), r.all_clear) for r in e.collect()}
    want = score_brute(w, o, slots, runs)
    assert got == want and {x[4] for x in want} == {"hit", "late", "false_alarm", "pending", "unscorable", "miss", "miss_late", "uncovered"}
    n = matching.pooled_summary(e.withColumn("g", F.lit(1)), ["g"]).first()
    assert n.hits + n.late + n.false_alarms == n.warnings and n.hits + n.late + n.misses == n.n_onsets - n.pending_onsets - n.uncovered_onsets and n.n_sent == len(w)
    errors = sorted(x[5] for x in want if x[4] == "hit" and x[5] is not None)
    assert np.allclose([n.error_p25, n.error_p50, n.error_p75], np.percentile(errors, [25, 50, 75]))
    bare = matching.score_warnings(sent, onsets)
    assert {r.outcome for r in bare.collect()} == {"hit", "late", "false_alarm", "miss", "miss_late"}
    assert matching.score_warnings(sent.where("false"), onsets.where("false")).count() == 0


def test_rule_sequences():
    def play(rows, **k):
        s = matching.fresh()
        return [matching.step(s, t * MIN, p, wet, 50, matching.Rule(persistence=k.get("persistence", 1))) for t, p, wet in rows]

    assert play([(0, 0.6, False), (5, 0.9, False), (10, 0.1, False), (15, 0.1, False), (20, 0.1, False)]) == ["notify", "none", "none", "all_clear", "none"]
    assert play([(0, 0.6, True), (10, 0.1, False), (70, 0.9, False)]) == ["already_raining", "none", "notify"]
    assert play([(0, 0.6, False), (0, 0.9, False), (5, None, False)], persistence=2) == ["none", "none", "none"]
    assert play([(0, 0.6, False), (5, 0.6, False)], persistence=2) == ["none", "notify"]


def test_rule_with_two_thresholds_and_quiet_hours():
    r = matching.Rule(onset_threshold=40, single_threshold=80)
    assert matching.over(0.6, 50, r, 0.5) and not matching.over(0.6, 50, r, 0.3) and not matching.over(0.6, 50, r) and matching.over(0.85, 50, r, float("nan"))
    s, act = matching.fresh(), []
    for t, p, quiet in [(0, 0.9, True), (5, 0.9, True), (10, 0.9, False), (15, 0.1, False), (20, 0.1, False), (25, 0.1, False), (80, 0.9, False)]:
        act.append(matching.step(s, t * MIN, p, False, 50, matching.Rule(), quiet=quiet))
    assert act == ["deferred_quiet", "deferred_quiet", "notify", "none", "all_clear", "none", "notify"]


def test_stream_rule_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [("abc"[i % 3], i * 7 * MIN, i, rng.random(), rng.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "station_id string, us long, row_id long, p double, raining boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    live = pipelines.run(pipelines.decide(pipelines.read(spark, str(tmp_path), "d"), 60))
    fed = pipelines.feed(df, F.col("us"), lambda d: pipelines.decide(d, 60), parts=3)
    assert {(r.row_id, r.action) for r in live.collect()} == {(r.row_id, r.action) for r in fed.collect()} and fed.select("batch").distinct().count() == 3
    batch = matching.replay(df, thresholds=[60], gap_min=10**6)
    assert {(r.row_id, r.action) for r in live.collect()} == {(r.row_id, r.action) for r in batch.collect()}


def test_pool_adjacent_violators():
    rng = np.random.default_rng(0)
    for _ in range(30):
        y, w = rng.random(12), rng.random(12) + 0.1
        c, k = np.r_[0, np.cumsum(y * w)], np.r_[0, np.cumsum(w)]
        want = [max(min((c[j + 1] - c[a]) / (k[j + 1] - k[a]) for j in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(calibration.pool_violators(y, w), want)


def test_curve_is_interpolated_and_clamped(spark):
    curve = spark.createDataFrame([(1, 0.2, 0.1), (1, 0.4, 0.5)], "g int, p double, fitted double")
    rows = spark.createDataFrame([(1, p) for p in (0.0, 0.2, 0.3, 0.4, 0.9)] + [(2, 0.3)], "g int, p double")
    got = {(r.g, r.p): r.calibrated for r in calibration.apply_curve(rows, curve, ["g"]).collect()}
    assert got[2, 0.3] is None and np.allclose([got[1, p] for p in (0.0, 0.2, 0.3, 0.4, 0.9)], [0.1, 0.1, 0.3, 0.5, 0.5])


def test_components(spark):
    chain = list(range(1, 5001))
    random.Random(0).shuffle(chain)  # a long chain in no order
    edges = list(zip(chain, chain[1:])) + [(6050, 6051), (6060, 6060), (None, 6060)]
    nodes = spark.createDataFrame([(i,) for i in [*chain, 6050, 6051, 6060, 6070, None]], "id long")
    got = {r.id: r.component for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 5004 and {got[i] for i in chain} == {1} and got[6051] == 6050 and got[6060] == 6060 and got[6070] == 6070
    assert connected_components(nodes.where("false"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_helpers_match_whole_series(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 3000), i, rng.choice([1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    runs = {r.i: (r.run, r["__start"]) for r in blocks.run_numbers(df, ["k"], "t", 40, 100).collect()}
    sums = {r.i: r.s for r in blocks.running_sums(df, ["k"], [F.col("t"), F.col("i")], blocks.block_of(F.col("t"), 100), {"s": F.col("v")}).collect()}
    prev = sorted((r.k or "", r.t, r["__prev"] is None) for r in blocks.previous(df, ["k"], "t", 100).collect())
    last = {r.i: r.got for r in blocks.last_before(df.select("k", "t", "i"), spark.createDataFrame([(k, t, t) for k in "ab" for t in (5, 700, 2200)], "k string, u long, got long"), key="k", left_us="t", right_us="u", value="got", width=100).collect()}
    for k in ("a", "b", None):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k)
        run, start, total = 0, own[0][0], 0
        for j, (t, i, v) in enumerate(own):
            if j and t - own[j - 1][0] > 40:
                run, start = run + 1, t
            total += v
            assert runs[i] == (run, start) and sums[i] == total
            assert last[i] == (None if k is None else max((u for u in (5, 700, 2200) if u <= t), default=None))
    assert sum(x[2] for x in prev) == 3


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(0, 20, 500), 1)
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(x)] + [("a", None), ("a", float("nan")), ("z", None)], "g string, v double")
    got = {r.g: r for r in V.quantiles(df, ["g"], "v", (0.0, 0.25, 0.9, 1.0), 3.0).collect()}
    assert set(got) == {"a", None}
    for g, own in (("a", x[np.arange(500) % 3 > 0]), (None, x[np.arange(500) % 3 == 0])):
        assert np.allclose(got[g][2:], np.percentile(own, [0, 25, 90, 100])) and got[g].n == len(own)


def test_places_far_north_and_over_the_meridian(spark):
    rng = random.Random(2)
    p = [("n1", 69.0, 20.0), ("n2", 69.0, 21.4), ("e", 10.0, 179.9), ("w", 10.0, -179.9), ("p1", 89.9, 0.0), ("p2", 89.9, 180.0), ("x", None, 1.0), ("y", float("nan"), 1.0)] + [(f"r{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(f"d{i}", 85 + rng.random() * 5, rng.uniform(-180, 180)) for i in range(100)]
    got = {(r.a, r.b) for r in spatial.near_pairs(spark.createDataFrame(p, "id string, lat double, lon double"), "id", 400.0).collect()}
    q = [x for x in p if x[1] is not None and x[1] == x[1]]
    want = {(a[0], b[0]) for a in q for b in q if a[0] != b[0] and spatial.km_between(np.array([a[1]]), np.array([a[2]]), np.array([b[1]]), np.array([b[2]]))[0] <= 400}
    assert got == want and {("n1", "n2"), ("e", "w"), ("p1", "p2")} <= got


def test_long_station_numbers_stay_whole(spark):
    df = spark.createDataFrame([(" 612 ",), ("123456",), ("1234567",), (None,)], "s string")
    assert [r[0] for r in df.select(station_number(F.col("s"))).collect()] == ["00612", "123456", "1234567", None]


def test_isotonic_over_chunks_equals_the_whole(spark):
    rng = np.random.default_rng(1)
    p = rng.random(3000)
    y = (rng.random(3000) < p).astype(float)
    df = spark.createDataFrame([(None if i % 2 else 1, float(a), float(b), float(1 + i % 3)) for i, (a, b) in enumerate(zip(p, y))], "g int, p double, y double, w double")
    got = calibration.isotonic(df, ["g"]).collect()
    for g in (None, 1):
        k = np.flatnonzero((np.arange(3000) % 2 == 1) == (g is None))
        k = k[np.argsort(p[k])]
        mine = sorted((r.p, r.fitted) for r in got if r.g == g)
        assert np.allclose([f for _, f in mine], calibration.pool_violators(y[k], 1.0 + k % 3))


def test_keyed_table_is_idempotent(spark, tmp_path):
    d = lambda rows: spark.createDataFrame(rows, "k long, v string, at long, day string")
    path = str(tmp_path / "t")
    for _ in range(2):
        store.append_idempotent(spark, path, d([(1, "a", 1, "d1"), (2, "b", 1, "d2")]), ["k"], [F.col("at")], "day")
        store.append_idempotent(spark, path, d([(1, "c", 2, "d1"), (3, "n", 1, "d1")]), ["k"], [F.col("at")], "day")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "c"), (2, "b"), (3, "n")}


def test_align_union_merge(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, None), (2, "y")], "k int, v string")
    assert store.align(a, spark.createDataFrame([], "v string, n double").schema).columns == ["v", "n"]
    assert {(r.k, r.v) for r in store.merge_preferring_known(b, a, ["k"], ["v"]).collect()} == {(1, "x"), (2, "y")}


def test_bad_features_keep_their_reason(spark):
    raw = spark.createDataFrame([("nope",), ('{"properties":{"stationId":"1","observed":"2026-05-01T00:00:00Z","parameterId":"p","value":1.5}}',), ('{"properties":{"observed":"2026-05-01T00:00:00Z"}}',), ('{"properties":{"stationId":"1","observed":"x","parameterId":"p"}}',)], "feature string")
    assert sorted(r.reason for r in geojson.parse_observations(raw).collect()) == ["no station", "no time", "not json", "ok, no created"]


def test_empty_denominators_are_null(spark):
    t = spark.createDataFrame([(0, 0, 0, 5)], "hits int, misses int, false_alarms int, correct int").select(*[c.alias(k) for k, c in V.table_scores().items()]).first()
    assert t.pod is None and t.far is None and t.csi is None and t.f1 is None


def test_ensemble_by_hand(spark):
    m = [[0.0, 0.6, 0.0], [0.0, 0.0, 0.7], [0.9, 0.0, 0.0], [float("nan"), 0.0, 0.0]]
    r = ensemble.ensemble_products(spark.createDataFrame([(m,)], "m array<array<double>>"), members="m", n_steps=3, leads={5: 1, 10: 2, 15: 3}, threshold=0.5, step_min=5).first()
    assert (r.p_5, r.p_10, r.p_15, r.eta_min) == (0.25, 0.5, 0.75, 10)


def test_live_panes_are_corrected_later_and_forgotten(spark):
    """A pane emitted in one batch is corrected in a later one; past the cut-off its state goes."""
    t = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)
    h = dt.timedelta(hours=1)
    data = [(1, "a", t, 1.0, t), (2, "a", t + h / 6, 0.5, t + h / 6), (3, "a", t, 2.0, t + 5 * h), (4, "b", t + 6 * h, 1.0, t + 6 * h), (5, "a", t + h / 6, 9.0, t + 25.5 * h), (6, "b", t + 40 * h, 1.0, t + 40 * h), (7, "b", t + 60 * h, 1.0, t + 60 * h), (8, "b", t + 61 * h, 0.2, t + 61 * h)]
    df = spark.createDataFrame([(i, s, o, "precip_past10min", v, c) for i, s, o, v, c in data], "obs_id long, station_id string, observed_utc timestamp, parameter_id string, value double, created_utc timestamp")
    seen = []
    e = pipelines.feed(df, F.unix_micros("created_utc"), pipelines.live_panes, parts=4, progress=seen)
    a = [(r.batch, r.n, r.amount) for r in e.where("station_id = 'a'").orderBy("batch").collect()]
    assert [x[1:] for x in a] == [(2, 15), (2, 25)] and a[0][0] < a[1][0]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in seen]
    assert len({(r.station_id, r.pane_us) for r in e.collect()}) == 5 and kept[-1] < 5


def test_streamed_store_keeps_the_last_delivery(spark):
    rows = [(k % 7, k, f"d{k % 7 % 2}") for k in range(40)]
    path = pipelines.scratch(spark) + "/t"
    df = spark.createDataFrame(rows, "k long, at long, day string")
    pipelines.feed(df, F.col("at"), lambda s: s, sink=pipelines.last_deliveries(path, ["k"], [F.col("at")], "day"))
    assert {(r.k, r["at"]) for r in spark.read.parquet(path).collect()} == {(k, max(a for i, a, _ in rows if i == k)) for k in range(7)}
