from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketmood import storage
from marketmood.operators import learned, lexicon
from marketmood.plans import workflow
from marketmood.plans.models import LearnedModel, LexiconModel
from marketmood.sources import news, prices, sinks
from marketmood.sources.schemas import ARTICLES, STORIES

D = dt.date(2024, 1, 1)


def put(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_articles(spark, tmp_path):
    path = put(tmp_path / "a.json", [
        {"ticker": "A", "articles": [
            {"publishedAt": "2024-01-02T08:00:00Z", "title": "t", "description": None, "content": "c"},
            {"title": "no date"}]},
        {"ticker": "B", "articles": []},
    ])
    rows = news.flatten_articles(news.read_payloads(spark, path, ARTICLES)).collect()
    assert {tuple(r) for r in rows} == {
        ("2024-01-02", "t", "", "c", "A", "newsapi"), ("", "no date", "", "", "A", "newsapi")}


def test_malformed_payload_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"ticker": "A", "articles": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        news.read_payloads(spark, str(tmp_path / "bad.json"), ARTICLES).collect()


def test_story_range_is_inclusive_at_midnight(spark, tmp_path):
    def ms(*at):
        return int(dt.datetime(*at, tzinfo=dt.timezone.utc).timestamp() * 1000)

    path = put(tmp_path / "s.json", [{"ticker": "A", "stories": [
        {"time": ms(2024, 1, 1), "title": "start"},
        {"time": ms(2024, 1, 3), "title": "end"},
        {"time": ms(2024, 1, 3, 0, 0, 1), "title": "late"},
        {"time": ms(2023, 12, 31, 23, 59, 59), "title": "early"}]}])
    rows = news.flatten_stories(
        news.read_payloads(spark, path, STORIES), "2024-01-01", "2024-01-03").collect()
    assert {(r["date"], r["title"]) for r in rows} == {("2024-01-01", "start"), ("2024-01-03", "end")}


def fetched(spark, rows):
    return spark.createDataFrame(
        rows, "date string, title string, description string, content string, ticker string, source string")


def test_union_keeps_duplicates_and_missing_dates(spark):
    one = fetched(spark, [("2024-01-01", "t", "", "", "A", "newsapi"), (" \t", "x", "", "", "A", "newsapi")])
    two = fetched(spark, [("2024-01-01", "t", "", "", "A", "tickertick"), (None, "n", "", "", "B", "tickertick")])
    assert news.union_sources([one, one, two]).count() == 4
    assert news.union_sources([one, two], ["B"]).count() == 1
    assert news.union_sources([one, two], sources=["tickertick"]).count() == 2
    with pytest.raises(KeyError, match="content"):
        news.union_sources([one.drop("content")])


def test_landing_reuses_what_is_there(spark, tmp_path):
    path = str(tmp_path / "landing")
    first = fetched(spark, [("2024-01-01", "old", "", "", "A", "newsapi")])
    news.land_news(news.typed(first), path, "2024-01-01", "2024-01-31")
    second = fetched(spark, [("2024-01-01", "new", "", "", "A", "newsapi"),
                             ("2024-01-02", "b", "", "", "B", "newsapi")])
    landed = news.land_news(news.typed(second), path, "2024-01-01", "2024-01-31")
    assert {(r["ticker"], r["title"]) for r in landed.collect()} == {("A", "old"), ("B", "b")}
    assert landed.select("news_id").distinct().count() == 2
    third = news.land_news(news.typed(second), path, "2024-02-01", "2024-02-28")
    assert third.count() == 2 and spark.read.schema(news.LANDED).parquet(path).count() == 4


RANGE = ("2024-01-01", "2024-01-31")


def test_two_runs_of_one_range_land_a_ticker_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landing")
    ours = news.typed(fetched(spark, [("2024-01-01", "ours", "", "", t, "newsapi") for t in ("A", "B", "x/y z")]))
    theirs = news.typed(fetched(spark, [("2024-01-02", "theirs", "", "", t, "newsapi") for t in ("B", "C")]))
    publish = news._publish

    def after_the_other_run(session, staged, place):
        monkeypatch.setattr(news, "_publish", publish)
        news.land_news(theirs, path, *RANGE)
        return publish(session, staged, place)

    monkeypatch.setattr(news, "_publish", after_the_other_run)
    landed = news.land_news(ours, path, *RANGE)
    want = [("A", "ours"), ("B", "theirs"), ("C", "theirs"), ("x/y z", "ours")]
    assert sorted((r["ticker"], r["title"]) for r in landed.collect()) == want
    assert not list((tmp_path / "landing").glob("_staged*"))
    again = news.land_news(ours, path, *RANGE)
    assert sorted((r["ticker"], r["title"]) for r in again.collect()) == want


def test_a_run_that_ends_early_shows_whole_tickers_or_none(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landing")
    rows = news.typed(fetched(spark, [("2024-01-01", f"t{i}", "", "", t, "newsapi") for t in "AB" for i in range(20)]))

    def killed(*_):
        raise RuntimeError("killed")

    publish = news._publish
    monkeypatch.setattr(news, "_publish", killed)
    with pytest.raises(RuntimeError):
        news.land_news(rows, path, *RANGE)
    assert not news._exists(spark, path)
    monkeypatch.setattr(news, "_publish", publish)
    assert news.land_news(rows.filter("ticker = 'A'"), path, *RANGE).count() == 20
    assert news.land_news(rows, path, *RANGE).count() == 40
    assert news.land_news(rows.limit(0), str(tmp_path / "empty"), *RANGE).count() == 0


def test_landing_keeps_tickers_and_ids_apart(spark, tmp_path):
    path = str(tmp_path / "landing")
    rows = [("2024-01-01", "t", "", "", x, "newsapi") for x in ("0700", "700", "1E5", "700")]
    first = news.land_news(news.typed(fetched(spark, rows)), path, "2024-01-01", "2024-01-31")
    assert sorted(r["ticker"] for r in first.collect()) == ["0700", "1E5", "700", "700"]
    ids = {r["news_id"] for r in first.collect()}
    assert len(ids) == 4
    later = news.land_news(news.typed(fetched(spark, rows[:1])), path, "2024-02-01", "2024-02-28")
    assert {r["news_id"] for r in later.collect()}.isdisjoint(ids) and later.count() == 1
    pruned = news._range(spark, path, "2024-02-01", "2024-02-28")
    assert "PartitionFilters: [isnotnull(from_date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_tables_by_ticker_come_back_as_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "0700"), (2, "700"), (3, "1E5")], "n long, ticker string")
    sinks.write_by_ticker(rows, str(tmp_path / "t"))
    for back in (sinks.read_table(spark, str(tmp_path / "t")), sinks.read_table(spark, str(tmp_path / "t"), "n LONG, ticker STRING")):
        assert sorted((r["n"], r["ticker"]) for r in back.collect()) == [(1, "0700"), (2, "700"), (3, "1E5")]


def test_top_and_lookup(spark):
    rows = spark.createDataFrame(
        [(i, "A", i % 7) for i in range(50)] + [(99, "B", 1)], "news_id long, ticker string, score int")
    top = news.top_per_ticker(rows, "score", 3)
    assert [r["news_id"] for r in top.filter("ticker = 'A'").orderBy("rank").collect()] == [6, 13, 20]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    names = news.companies(spark)
    asked = spark.createDataFrame([("AAPL",), ("XYZ",)], "ticker string")
    got = {r["ticker"]: (r["search_phrase"], r["feed_ticker"]) for r in news.company_lookup(asked, names).collect()}
    assert got == {"AAPL": ("AAPL OR Apple Inc", "aapl"), "XYZ": ("XYZ OR XYZ", "xyz")}


def test_phrase_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Sentence,Sentiment\n"Up, they said ""go""",positive\nDown,negative\n')
    phrases = news.read_phrases(spark, str(tmp_path / "p.csv"))
    from marketmood.functions.labels import SENTIMENT_WORDS

    rows = news.phrase_labels(phrases, "sentiment", SENTIMENT_WORDS).collect()
    assert {tuple(r) for r in rows} == {('Up, they said "go"', "bullish"), ("Down", "bearish")}


def bar_rows(spark, tickers=("A", "B"), n=30):
    rows = [
        (D + dt.timedelta(days=i), t, 1.0 + i, 2.0 + i, 0.5, 10.0 + (i * (k + 3)) % 7, 100)
        for k, t in enumerate(tickers) for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "date date, ticker string, open double, high double, low double, close double, volume long")


def index_rows(spark, n=30):
    return bar_rows(spark, ("I",), n).drop("ticker")


def test_bars_round_trip_range_and_nan(spark, tmp_path):
    bars = bar_rows(spark).withColumn(
        "close", F.when(F.dayofmonth("date") == 3, float("nan")).otherwise(F.col("close")))
    path = str(tmp_path / "bars")
    sinks.write_by_ticker(bars, path)
    read = prices.read_bars(spark, path)
    kept = prices.stock_bars(read, ["A"], "2024-01-02", "2024-01-05")
    rows = {r["date"].day: r["close"] for r in kept.collect()}
    assert set(rows) == {2, 3, 4} and rows[3] is None
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "GreaterThanOrEqual(date" in plan
    csv = str(tmp_path / "csv")
    index_rows(spark).coalesce(1).write.csv(csv, header=True)
    market = prices.read_bars(spark, csv, market=True, fmt="csv")
    assert prices.index_bars(market, end="2024-01-03").count() == 2


def test_overwrite_replaces_only_written_tickers(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_by_ticker(bar_rows(spark, ("A", "B")), path)
    sinks.write_by_ticker(bar_rows(spark, ("B",), 2), path)
    assert {tuple(r) for r in spark.read.parquet(path).groupBy("ticker").count().collect()} == {("A", 30), ("B", 2)}


def test_metric_and_parameter_files(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 0.25, 1 / 3, 0.1)], "accuracy double, precision double, recall double, f1 double")
    sinks.write_metrics_text(metrics, "Ensemble", str(tmp_path / "m"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert text == ["Ensemble Performance:", "Accuracy: 0.5000", "Precision: 0.2500", "Recall: 0.3333", "F1-Score: 0.1000"]
    best = spark.createDataFrame([(0.1, 0.6, 0.9)], "pos_thresh double, weight double, accuracy double")
    sinks.write_blend(best, str(tmp_path / "b"))
    assert sinks.read_blend(spark, str(tmp_path / "b")) == (0.1, 0.6)
    back = spark.createDataFrame([("A", 0.1, None), ("B", 0.2, 1.0)], "ticker string, total_return double, sharpe_ratio double")
    sinks.write_backtest_metrics(back, str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).count() == 2


def test_backtest_folders_are_shared_out(spark, tmp_path):
    """A folder per ticker, written by several tasks and read by few; only the tickers written are replaced."""
    path = tmp_path / "k"
    schema = "ticker string, total_return double, sharpe_ratio double"
    rows = spark.createDataFrame([(f"{i:04d}", i / 4, None) for i in range(40)], schema)
    grouped = rows.groupBy("ticker").agg(F.max("total_return").alias("total_return"), F.max("sharpe_ratio").alias("sharpe_ratio"))
    sinks.write_backtest_metrics(grouped, str(path))
    files = list(path.glob("ticker=*/part-*.json"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    sinks.write_backtest_metrics(spark.createDataFrame([("0007", 9.0, 2.0)], schema), str(path))
    found = sinks.read_backtest_metrics(spark, str(path))
    assert found.columns == ["total_return", "sharpe_ratio", "ticker"] and found.rdd.getNumPartitions() <= 4
    assert {tuple(r) for r in found.collect()} == {(i / 4, None, f"{i:04d}") for i in range(40) if i != 7} | {(9.0, 2.0, "0007")}


@pytest.mark.parametrize("tmpdir", [None, "/scratch/own"])
def test_a_cluster_needs_a_shared_folder(monkeypatch, tmpdir):
    class Conf:
        def __init__(self, path):
            self.settings = {"spark.checkpoint.dir": path, "spark.local.dir": "/disk1/spark,/disk2/spark"}

        def get(self, name, *_):
            return self.settings.get(name)

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

    if tmpdir:
        monkeypatch.setattr(storage.tempfile, "gettempdir", lambda: tmpdir)
    for path in (None, "/tmp", "/tmp/checkpoints", "file:///tmp/x", "/var/tmp/x", "file:/dev/shm/x", "/disk2/spark/x", f"{tmpdir or '/tmp'}/x"):
        Session.conf = Conf(path)
        with pytest.raises(ValueError):
            storage.shared_dir(Session)
    for path in ("hdfs://shared/x", "/mnt/shared/tmp", "/tmpfiles/x"):
        Session.conf = Conf(path)
        assert storage.shared_dir(Session) == path


def test_written_table_and_size_check(spark):
    frame = storage.written(spark.range(10), "ten")
    assert frame.count() == 10
    assert storage.table_bytes(spark.createDataFrame([("abc", 1)], "t string, n int")) == 3 + 32
    few = storage.small(spark.range(10))._jdf.queryExecution().logical().toString()
    many = storage.small(spark.range(10), limit=8)._jdf.queryExecution().logical().toString()
    assert "broadcast" in few.lower() and "broadcast" not in many.lower()


def news_rows(spark):
    words = ["profit rises", "loss widens", "board meets monday", "great growth", "weak sales"]
    rows = [
        (i, D + dt.timedelta(days=i % 30), words[i % 5], f"about item{i % 4}", "", "AB"[i // 30 % 2], "newsapi")
        for i in range(240)
    ]
    return spark.createDataFrame(
        rows, "news_id long, date date, title string, description string, content string, ticker string, source string")


def test_workflows(spark, tmp_path):
    inputs = workflow.Inputs(news_rows(spark), bar_rows(spark), index_rows(spark))
    model, metrics = workflow.classify(
        inputs, "ensemble", str(tmp_path / "w"), member=LearnedModel(1 << 8, 5),
        words=LexiconModel(lexicon.seed_lexicon(spark)))
    assert metrics.first()["n"] > 0
    rows = spark.read.parquet(str(tmp_path / "w" / "processed_news"))
    assert rows.count() == 240
    days, result = workflow.follow_tickers(model, rows, inputs.stock, path=str(tmp_path / "bt"))
    assert result.count() == 2 and days.filter("portfolio < 0").count() == 0
    labels = spark.read.parquet(str(tmp_path / "w" / "sentiment_labels"))
    tables = workflow.chart_tables(inputs, labels)
    assert tables["series"].count() == 90 and tables["markers"].count() == 60

    def loader():
        def run(texts):
            return {"sentiment": np.array(["bullish"] * len(texts)),
                    "embedding": np.array([[len(t), 1.0] for t in texts], dtype="float32")}
        return run

    for by_time in (False, True):
        days, error = workflow.forecast_close(inputs, loader, 2, by_time=by_time)
        assert days.count() == 60 and error.first()["n"] > 0
    with pytest.raises(ValueError):
        workflow.classify(workflow.Inputs(inputs.news.limit(0), inputs.stock, inputs.index), "vader", str(tmp_path))
    assert learned.from_logits(
        spark.createDataFrame([(1.0, 2.0)], "a double, b double"), {"bullish": "a", "bearish": "b"}
    ).first()["prediction"] == "bearish"
