"""The daily batch: every module for the whole universe, one row a ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import backtest, indicators, scores, text
from quantloom.sources import tables


def technical_modules(prices: DataFrame, rows: int = 150) -> DataFrame:
    """Latest indicators and score of each ticker over its newest ``rows`` bars."""
    recent = indicators.last_rows(prices, rows)
    bands = indicators.bollinger(recent).groupBy("ticker").agg(F.max_by(F.struct("close", "sma", "upper", "lower", "n_rows"), "bar_date").alias("b")).select("ticker", "b.*")
    folds = indicators.rsi_wilder(indicators.macd(indicators.closes(recent))).select("ticker", "rsi", "macd", "signal_line", "histogram", "ema_fast", "ema_slow")
    return scores.technical(bands.join(folds, "ticker"))


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a ticker: the three scores, the combined signal and the newest value of each macro series as a map."""
    tech = technical_modules(tables.bars(spark, sf_dir)).select("ticker", F.col("score").alias("tech"), F.col("signal").alias("tech_signal"))
    fund = scores.fundamental(tables.fundamentals(spark, sf_dir)).select("ticker", F.col("score").alias("fund"), F.col("signal").alias("fund_signal"))
    news = text.news_by_ticker(tables.news(spark, sf_dir)).select(F.regexp_replace("ticker", "^src", "NATION_").alias("ticker"), F.col("score").alias("news"), F.col("signal").alias("news_signal"))
    joined = tech.join(fund, "ticker", "full").join(news.where(F.col("ticker").isNotNull()), "ticker", "left")
    macro = tables.macro(spark, sf_dir).groupBy("indicator").agg(F.max_by("value", "data_date").alias("value"))
    one = macro.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("indicator", "value")))).alias("macro"))
    return scores.signal(joined).join(one)  # one row of bounded width beside every ticker


def full_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``analyze`` with all nine modules of each ticker as structs, and where each comes from.

    ``sec``, ``insider``, ``backtest``, ``walk_forward``, ``technical``, ``news_module``, ``fundamentals``, ``signal_module`` and ``prediction`` (a map by horizon);
    a module is null where a ticker lacks the data for it. ``lineage`` maps each module to its source table, tier and confidence.
    """
    prices = tables.bars(spark, sf_dir)
    found = tables.fundamentals(spark, sf_dir)
    rated = scores.fundamental(found).select("ticker", F.struct("revenue", "de_ratio").alias("sec"), F.struct("insiders", F.col("insider").alias("score")).alias("insider"), F.struct("profit", "leverage", "score", F.col("signal"), "confidence").alias("fundamentals"))
    tested = backtest.metrics(backtest.run(prices)).select("ticker", F.struct("periods", "accuracy", "win_rate", "total_return", "worst", "sharpe").alias("backtest"))
    walked = backtest.walk_summary(backtest.walk_accuracy(backtest.walk_scores(backtest.walk_windows(prices))))
    walked = walked.select("ticker", F.struct("windows", "in_sample", "out_sample", "consistency", "stability", "confidence", "verdict").alias("walk_forward"))
    tech = technical_modules(prices).select("ticker", F.struct("close", "sma", "upper", "lower", "rsi", "macd", "signal_line", "histogram", "score", F.col("signal"), "confidence").alias("technical"))
    press = text.news_by_ticker(tables.news(spark, sf_dir)).where(F.col("ticker").isNotNull())
    press = press.select(F.regexp_replace("ticker", "^src", "NATION_").alias("ticker"), F.struct("articles", "score", F.col("signal"), "confidence").alias("news_module"))
    ahead = backtest.horizons(prices).groupBy("ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("horizon").cast("string"), F.struct("p_up", "e_ret", "samples").alias("of"))))).alias("prediction"))
    out = analyze(spark, sf_dir).withColumn("signal_module", F.struct("tech", "fund", "news", "combined", F.col("signal"), "agreement"))
    for part in (rated, tested, walked, tech, press, ahead):
        out = out.join(part, "ticker", "left")
    return out.withColumn("lineage", F.create_map(*(x for m, (source, tier, sure) in LINEAGE.items() for x in (F.lit(m), F.struct(F.lit(source).alias("source"), F.lit(tier).alias("tier"), F.lit(sure).alias("confidence"))))))


#: Module to the table that it is made of, its tier (1: official records, 2: market data, 3: press and derived values) and how far it is trusted.
LINEAGE = {
    "sec": ("lineitem, supplier", 1, 95), "insider": ("supplier", 1, 95), "fundamentals": ("lineitem, supplier", 1, 95), "technical": ("lineitem", 2, 85), "backtest": ("lineitem", 2, 85),
    "walk_forward": ("lineitem", 2, 85), "prediction": ("lineitem", 2, 85), "news_module": ("documents", 3, 70), "signal_module": ("technical, fundamentals, news", 3, 70),
}
