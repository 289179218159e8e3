"""Every registered query with an oracle gives the oracle's rows, digit for digit."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from marketmood.checks.oracles import ORACLES
from marketmood.checks.queries import REGISTRY as QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# Results of fitted models, which SQL cannot express; each has a test of its own.
FITTED = {"learned_predict", "learned_stages", "forecast_ensemble_mse"}


def test_every_query_but_fitted_ones_has_an_oracle():
    assert set(QUERIES) - FITTED == set(ORACLES)


def test_fitted_predictions(spark, sf_dir):
    rows = QUERIES["learned_predict"](spark, sf_dir).collect()
    assert rows and {"bullish", "neutral", "bearish"} == {c for c in rows[0].asDict() if c in ("bullish", "neutral", "bearish")}
    assert sum(r["prediction"] == r["sentiment"] for r in rows) >= 0.2 * len(rows)


def test_specific_stage_raises_the_held_out_likelihood(spark, sf_dir):
    general, specific = sorted(QUERIES["learned_stages"](spark, sf_dir).collect(), key=lambda r: r["stage"])
    assert general["n"] == specific["n"] > 0
    assert specific["log_likelihood"] > general["log_likelihood"]


def test_forecast_is_better_than_the_last_close(spark, sf_dir):
    (row,) = QUERIES["forecast_ensemble_mse"](spark, sf_dir).collect()
    assert row["n"] > 0 and row["mse"] < row["last_close_mse"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    result = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert result["columns"] and not result["types"], result["types"]
    assert result["rows"][0] == result["rows"][1]
    assert result["equal"], result["differences"]


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert "text_length" in frame.columns and frame.count() > 0
