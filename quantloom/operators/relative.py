"""Relative strength, beta and momentum over calendar windows ending at ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import ladder
from quantloom.operators.indicators import over


def period_return(prices: DataFrame, as_of, days: int, *keys: str) -> DataFrame:
    """``ret`` in percent from the first to the last close of the window, null with under two rows."""
    part = prices.where((F.col("bar_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("bar_date") <= F.lit(as_of)))
    got = part.groupBy(*keys).agg(F.min_by("close", "bar_date").alias("first"), F.max_by("close", "bar_date").alias("last"), F.count("*").alias("rows"))
    return got.select(*keys, F.when(F.col("rows") >= 2, (F.col("last") / F.nullif(F.col("first"), F.lit(0.0)) - 1) * 100).alias("ret"))


def market(prices: DataFrame, *keys: str) -> DataFrame:
    """Mean close of all tickers (of each of ``keys``) by date: the index series."""
    return prices.groupBy(*keys, "bar_date").agg(F.avg("close").alias("close"))


def relative_strength(prices: DataFrame, as_of, days: int = 90) -> DataFrame:
    """``ticker, sector, ret, sector_ret, relative, signal``; a sector without a series counts 0."""
    own = period_return(prices, as_of, days, "ticker", "sector")
    etf = period_return(market(prices, "sector"), as_of, days, "sector").withColumnRenamed("ret", "sector_ret")
    out = own.join(etf, "sector", "left").withColumn("sector_ret", F.coalesce("sector_ret", F.lit(0.0)))
    return out.withColumn("relative", F.col("ret") - F.col("sector_ret")).withColumn("signal", ladder("relative", (">", 5, "OUTPERFORMING"), ("<", -5, "UNDERPERFORMING"), other="IN_LINE"))


def with_market(prices: DataFrame) -> DataFrame:
    """``ticker, bar_date, r, m``: daily returns of each ticker and of the index, joined by date."""
    index = market(prices).withColumn("ticker", F.lit("index"))
    ret = F.col("close") / F.nullif(F.lag("close").over(over()), F.lit(0.0)) - 1
    mine = prices.withColumn("r", ret).where("r is not null").select("ticker", "bar_date", "r")
    theirs = index.withColumn("m", ret).where("m is not null").select("bar_date", "m")
    return mine.join(theirs, "bar_date")


def beta(prices: DataFrame, as_of, days: int = 365) -> DataFrame:
    """Sample covariance over population variance of daily returns, joined by date; no variance gives 0."""
    recent = prices.where((F.col("bar_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("bar_date") <= F.lit(as_of)))
    out = with_market(recent).groupBy("ticker").agg(F.coalesce(F.covar_samp("r", "m") / F.nullif(F.var_pop("m"), F.lit(0.0)), F.lit(0.0)).alias("beta"))
    return out.withColumn("signal", ladder("beta", (">", 1.2, "HIGH_VOLATILITY"), (">", 0.8, "MARKET_CORRELATED"), other="LOW_VOLATILITY"))


def momentum(prices: DataFrame, as_of, days: int = 252) -> DataFrame:
    """Return over calendar days; under two rows: null and an ``error``."""
    out = period_return(prices, as_of, days, "ticker").withColumnRenamed("ret", "momentum")
    out = out.withColumn("trend", ladder("momentum", (">", 20, "STRONG_UP"), (">", 5, "MODERATE_UP"), ("<", -20, "STRONG_DOWN"), ("<", -5, "MODERATE_DOWN"), other="SIDEWAYS"))
    return out.withColumn("error", F.when(F.col("momentum").isNull(), "not enough rows"))
