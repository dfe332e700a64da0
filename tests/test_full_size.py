"""Queries at their full size: on the middle tables, which have hours enough."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from check_oracle import TABLES, compare
from tidemark.plans import ORACLES, QUERIES, q_models

MIDDLE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["w5_site_features_full", "w6_year_features_full", "w12_supervised_windows_full"])
def test_full_vectors_and_windows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{MIDDLE}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert len(want) and compare(QUERIES[name](spark, MIDDLE).toPandas(), want) == "ok"


def test_year_domains_have_all_leads_and_arms(spark):
    got = QUERIES["d15_year_domains"](spark, "/root/testdata/sf0.01").toPandas()
    assert set(got.horizon_h) == {24, 144, 576, 1728}
    assert set(got.arm) == {"pooled", "nearest", "koopman", "subspace", "oracle"}


def test_trees_of_every_horizon(spark, monkeypatch):
    made = q_models.boosted
    sizes = []
    monkeypatch.setattr(q_models, "boosted", lambda t, horizons, trees, depth: sizes.append((horizons, trees, depth)) or made(t, horizons, 2, 2))
    got = QUERIES["l17_boosted_trees"](spark, "/root/testdata/sf0.01").toPandas()
    assert sizes == [((24, 48, 72), 300, 6)]
    assert {(r.readout, r.horizon_h) for r in got.itertuples()} == {(k, h) for k in ("trees", "ridge") for h in (24, 48, 72)}
