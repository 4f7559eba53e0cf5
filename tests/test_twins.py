"""Every query with a SQL twin gives the twin's rows. The few without one are named, with the test that holds them."""

import pytest

from slotweave.plans import registry
from tests.helpers import BASE, database, rows

#: Queries that SQL cannot say and where they are held: models, spikes, filled series.
HELD = {
    "logistic_skill": "test_models.py::test_logistic_equals_numpy",
    "forest_scores": "test_models.py::test_trees_equal_plain_recursion",
    "harmonised_values": "test_models.py::test_quantile_maps_keep_the_share_above",
    "p3_found": "test_problems.py::test_spikes_are_told_from_shifts_and_fades",
    "p3_flags": "test_problems.py::test_a_source_is_fitted_over_all_its_blocks",
    "p5_series": "test_problems.py::test_fill_error_on_hidden_readings",
}


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, db, name):
    got = registry.QUERIES[name](spark, BASE).toArrow()
    want = db.sql(registry.ORACLES[name]).arrow().read_all()
    assert rows(got) == rows(want)


def test_all_others_are_held():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(HELD)


def test_held_queries_give_whole_tables(spark):
    """One row per row of the table, or only rows of it."""
    q = {n: registry.QUERIES[n](spark, BASE) for n in HELD}
    ids = {r[0] for r in spark.read.parquet(f"{BASE}/observations.parquet").select("obs_id").collect()}
    assert {r[0] for r in q["p3_found"].collect()} == {r.obs_id for r in q["p3_flags"].collect()} <= ids
    warned = spark.read.parquet(f"{BASE}/warnings_scored.parquet").where("station_id is not null and warned_at_utc is not null").count()
    f = q["forest_scores"].collect()
    assert len(f) == warned and all(0 < r.probability < 1 for r in f)
    h = q["harmonised_values"].collect()
    assert h and all(r.n > 0 for r in h)
    skill = q["logistic_skill"].collect()
    assert skill and all(r.brier_model < r.brier_raw * 1.3 for r in skill)
    s = q["p5_series"].groupBy("station_id").count().collect()
    assert s and all(r["count"] % 144 == 0 for r in s)
