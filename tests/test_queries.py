"""Every catalog query against its SQL counterpart, and the two trained detectors on their own."""

import oracle
import pytest
from conftest import SMALL

from faultloom.plans.catalog import QUERIES
from faultloom.plans.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    equal, message = oracle.compare(QUERIES[name](spark, SMALL), db, ORACLES[name])
    assert equal, message


def test_only_trained_detectors_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "isolation_forest_scores", "isolation_forest_tuning", "random_forest_predictions"}


def test_isolation_forest_query(spark):
    first = QUERIES["isolation_forest_scores"](spark, SMALL)
    rows = {r["event_id"]: r["score"] for r in first.collect()}
    assert len(rows) == 480 and all(0 < s <= 1 for s in rows.values())
    again = QUERIES["isolation_forest_scores"](spark, SMALL)
    assert {r["event_id"]: r["score"] for r in again.collect()} == rows


def test_random_forest_query(spark, db):
    blocks = db.execute(
        "SELECT count(DISTINCT (user_id, isoyear(ts), weekofyear(ts))) FROM events"
    ).fetchone()[0]
    rows = QUERIES["random_forest_predictions"](spark, SMALL).collect()
    assert len(rows) == blocks and 0 < sum(r["held_out"] for r in rows) < blocks
    assert all(0 <= r["score"] <= 1 and r["prediction"] in (0, 1) for r in rows)
