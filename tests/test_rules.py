"""Worked examples of every rule family."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import quality, scores, text


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "words,score",
    [
        ("Crowdstrike surges on strong earnings beat", 62), ("Cloudflare plunges on guidance miss", 44), ("Rocket Lab advanced growth momentum", 59),
        ("MarineMax sales decline sharply", 47), ("Stock surges on bullish earnings beat and strong growth outlook", 74), ("", 50), ("nothing of note", 50), (None, 50),
    ],
)
def test_news_sentiment(spark, words, score):
    assert value(spark, text.news_sentiment(F.lit(words).cast("string"))) == score


def test_fundamental_composites(spark):
    rows = spark.createDataFrame([(1.05e9, 0.12, 2), (9e8, 0.08, 2), (2e8, 0.18, 2), (None, None, None), (0.0, 3.0, 11)], "revenue double, de_ratio double, insiders int")
    got = [(r.score, r.signal) for r in scores.fundamental(rows).collect()]
    assert got == [(73.5, "BUY"), (69.5, "HOLD"), (59.5, "HOLD"), (50.0, "HOLD"), (49.25, "HOLD")]


def test_combined_signal(spark):
    rows = spark.createDataFrame([(61.75, 73.5, 52.01), (51.25, 69.5, 51.13), (38.25, 59.5, 51.14), (None, None, None)], "tech double, fund double, news double")
    got = [(r.combined, r.signal, r.agreement) for r in scores.signal(rows).collect()]
    assert got == [(65.19, "BUY", 59.26), (60.34, "HOLD", 57.25), (52.1, "HOLD", 48.93), (50.0, "HOLD", 60.0)]


def test_short_squeeze_options_analysts(spark):
    row = scores.short_squeeze(spark.createDataFrame([(15.0, 3.0, 8.0)], "short_pct double, days_to_cover double, momentum double")).first()
    assert (row.risk_score, row.signal) == (60, "MODERATE_SQUEEZE_RISK")
    row = scores.options(spark.createDataFrame([(1.1, 75.0)], "put_call double, iv_percentile double")).first()
    assert (row.score, row.sentiment) == (50, "NEUTRAL")
    row = scores.analysts(spark.createDataFrame([(65.0, 10.0, 18.0, "UPGRADING")], "buy_pct double, sell_pct double, upside double, trend string")).first()
    assert (row.score, row.signal) == (100, "STRONG_BUY")


def test_reliability_and_confidence(spark):
    assert value(spark, scores.reliability(scores.freshness(F.lit(None).cast("double")), F.lit(70.0))) == 69.5
    assert value(spark, scores.confidence(F.lit(50.0), F.lit(85.0))) == 68.75


def test_calibration(spark):
    grid = spark.createDataFrame([(55.0, 0, 52.0, 0.6, 10.0), (60.0, 1, 60.0, 1.0, 12.0), (65.0, 2, 60.0, 1.0, 12.0)], "param double, ordinal int, win double, sharpe double, dd double")
    best = scores.best_param(grid, scores.threshold_score(F.col("win"), F.col("sharpe"), F.col("dd")), 60.0).first()
    assert best.param == 60.0  # the first of equals
    assert scores.best_param(grid.limit(0), F.col("win"), 60.0).first().param == 60.0


def test_conflicts(spark):
    rows = spark.createDataFrame([("p", "yahoo", 150.25), ("p", "filing", 150.50), ("m", "a", 2.50), ("m", "b", 2.48), ("m", "c", 2.45), ("one", "a", 1.0)], "metric string, source string, value double")
    price = {r.metric: r for r in quality.price_conflict(rows, ["metric"]).collect()}
    assert round(price["p"].spread, 2) == 0.17 and price["p"].severity == "MINOR" and not price["p"].conflict and price["one"].spread is None
    metric = {r.metric: r for r in quality.metric_conflict(rows, ["metric"]).collect()}
    assert round(metric["m"].spread, 2) == 2.02 and round(metric["m"].mean, 3) == 2.477


def test_price_errors(spark):
    rows = spark.createDataFrame([(150.25, "2026-10-04"), (None, "2026-10-04"), (float("nan"), "2026-1-4"), (float("inf"), "never"), (0.001, "2026-01-01")], "v double, d string")
    e, w = quality.price_errors(F.col("v"), F.col("d"))
    got = [(r.e, r.w) for r in rows.select(e.alias("e"), w.alias("w")).collect()]
    assert got == [([], []), (["not numeric"], []), (["nan"], []), (["bad date", "infinite"], ["above usual"]), (["below minimum"], [])]


def test_anomaly(spark):
    row = quality.anomaly(spark.createDataFrame([(200.0, 6, 152.5, 1.707825)], "current double, n int, mean double, std double")).first()
    assert round(row.z, 2) == 27.81 and row.severity == "CRITICAL" and row.anomaly


def test_call_texts(spark):
    calls = spark.createDataFrame([("Strong growth, record quarter. We raised guidance; gross margin up",), ("guidance lowered on weakness",), ("hello",)], "text string")
    got = [(r.positive, r.negative, r.signal) for r in text.call_sentiment(calls).collect()]
    assert got == [(4, 0, "VERY_POSITIVE"), (0, 2, "VERY_NEGATIVE"), (0, 0, "NEUTRAL")]
    assert [r.g for r in calls.select(text.guidance(F.col("text")).alias("g")).collect()] == ["RAISED", "LOWERED", "NOT_PROVIDED"]
    assert text.topics(calls).first().topics == {"margin": 2}
