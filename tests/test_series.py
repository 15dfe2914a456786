"""Indicators, backtests and walk-forward windows against plain numpy and pandas."""

import datetime

import numpy as np
import pandas as pd

from quantloom.operators import backtest, indicators


def frame(spark, closes, ticker="T"):
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(ticker, day + datetime.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c)) for i, c in enumerate(closes)], "ticker string, bar_date date, open double, high double, low double, close double")


def walk(n, seed=7):
    return 100 + np.cumsum(np.random.default_rng(seed).normal(size=n)) * 0.5


def test_bands_match_pandas(spark):
    x = walk(300)
    got = indicators.bollinger(frame(spark, x)).orderBy("bar_date").toPandas()
    s = pd.Series(x)
    np.testing.assert_allclose(got["sma"], s.rolling(20).mean())
    np.testing.assert_allclose(got["std"], s.rolling(20).std(), atol=1e-9)
    assert got["sma"].isna().sum() == 19


def test_macd_matches_pandas(spark):
    x = walk(120)
    row = indicators.macd(indicators.closes(frame(spark, x))).first()
    s = pd.Series(x)
    line = s.ewm(span=12).mean() - s.ewm(span=26).mean()
    np.testing.assert_allclose(row.macd, line.iloc[-1], atol=1e-9)
    np.testing.assert_allclose(row.signal_line, line.ewm(span=9).mean().iloc[-1], atol=1e-9)


def plain_rsi(x, n=14):
    d = np.diff(x)
    up, down = d[: n + 1].clip(min=0).sum() / n, -d[: n + 1].clip(max=0).sum() / n
    for v in d[n - 1 :]:
        up, down = (up * (n - 1) + max(v, 0)) / n, (down * (n - 1) + max(-v, 0)) / n
    return 50 if down == 0 else 100 - 100 / (1 + up / down)


def test_rsi(spark):
    for x in (walk(150), walk(60, 3), np.arange(200.0), np.full(100, 50.0)):
        np.testing.assert_allclose(indicators.rsi_wilder(indicators.closes(frame(spark, x))).first().rsi, plain_rsi(x))


def test_atr_first_row_is_unknown(spark):
    got = indicators.true_range(frame(spark, walk(40))).orderBy("bar_date").toPandas()
    assert got["tr"].isna().sum() == 1 and got["atr"].isna().sum() == 14


def test_split_sizes(spark):
    prices = frame(spark, walk(499))
    assert {r.split: r["count"] for r in backtest.split(prices).groupBy("split").count().collect()} == {"train": 399, "test": 100}
    assert backtest.run(prices).count() == 76
    assert backtest.run_fixed(prices).count() == 76
    assert backtest.run_no_bias(prices).count() == 71
    assert {r.horizon: r.samples for r in backtest.horizons(prices).collect()} == {1: 99, 5: 95, 20: 80, 60: 40}


def test_walk_windows(spark):
    for n, windows in ((252, 0), (253, 1), (504, 1), (505, 2)):
        got = backtest.walk_windows(frame(spark, walk(n)))
        assert got.select("window_num").distinct().count() == windows
    parts = {r.part: r["count"] for r in backtest.walk_windows(frame(spark, walk(504))).groupBy("part").count().collect()}
    assert parts == {"train": 176, "test": 76}


def test_walk_summary(spark):
    day = datetime.date(2020, 1, 1)
    score = 50 + 20 * np.sin(np.arange(252) / 20)
    rows = [("T", 0, "train" if i < 176 else "test", day + datetime.timedelta(days=i), float(s)) for i, s in enumerate(score)]
    got = backtest.walk_accuracy(spark.createDataFrame(rows, "ticker string, window_num int, part string, bar_date date, score double"))
    a = got.first()
    assert (round(a.train, 2), round(a.test, 2), round(a.gap, 2), a.overfit) == (69.89, 59.21, 10.68, False)
    s = backtest.walk_summary(got).first()
    assert (s.spread, s.consistency, s.stability, s.confidence, s.verdict) == (0, 100, 100, 85, "NEEDS_TUNING")
