from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest

from marketmood.operators import backtest

D = dt.date(2023, 11, 1)


def test_value_and_metrics_match_a_plain_loop(spark):
    rng = random.Random(5)
    series = {
        f"T{k}": [(D + dt.timedelta(days=i), round(rng.uniform(1, 300), 2)) for i in range(n)]
        for k, n in enumerate([1, 2, 63, 200])
    }
    series["flat"] = [(D + dt.timedelta(days=i), 5.0) for i in range(4)]
    bars = spark.createDataFrame(
        [(t, d, c) for t, days in series.items() for d, c in days], "ticker string, date date, close double"
    )
    value = backtest.holding_value(bars)
    got = {}
    for r in sorted(value.collect()):
        got.setdefault(r["ticker"], []).append(r["portfolio"])
    metrics = {r["ticker"]: r for r in backtest.backtest_metrics(value).collect()}
    for ticker, days in series.items():
        want = [10000.0 * c / days[0][1] for _, c in days]
        assert got[ticker] == pytest.approx(want)
        m = metrics[ticker]
        if len(want) < 2:
            assert (m["total_return"], m["sharpe_ratio"]) == (0.0, 0.0)
            continue
        assert m["total_return"] == pytest.approx(want[-1] / 10000 - 1)
        returns = [b / a - 1 for a, b in zip(want, want[1:])]
        if len(returns) == 1:
            assert m["sharpe_ratio"] is None
        elif statistics.stdev(returns) == 0:
            assert m["sharpe_ratio"] == 0.0
        else:
            sharpe = statistics.mean(returns) / statistics.stdev(returns) * 252**0.5
            assert m["sharpe_ratio"] == pytest.approx(sharpe)


def test_first_signal_and_common_dates(spark):
    said = spark.createDataFrame(
        [(7, "A", D, "bearish"), (3, "A", D, "bullish"), (9, "B", D, "neutral")],
        "news_id long, ticker string, date date, prediction string",
    )
    signals = backtest.first_signal_per_day(said)
    assert {(r["ticker"], r["signal"]) for r in signals.collect()} == {("A", "bullish"), ("B", "neutral")}
    bars = spark.createDataFrame([("A", D, 1.0)], "ticker string, date date, close double")
    assert [tuple(r) for r in backtest.common_dates(said, bars).collect()] == [("A", D)]
