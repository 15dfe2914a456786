"""Backtests, walk-forward windows and horizon probabilities. Splits are made by position before any look ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions.columns import clamp, share
from quantloom.operators.indicators import forward_return, momentum, over


def numbered(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker")
    return prices.withColumn("rn", F.row_number().over(over())).withColumn("n", F.count("*").over(w))


def split(prices: DataFrame, train: float = 0.8) -> DataFrame:
    """``split``: train for the first share of a ticker's rows (truncated), else test."""
    return numbered(prices).withColumn("split", F.when(F.col("rn") <= (F.col("n") * F.lit(train)).cast("int"), "train").otherwise("test"))


def direction(x: str, by: float = 0.02):
    return F.when(F.col(x) > by, "UP").when(F.col(x) < -by, "DOWN").otherwise("FLAT")


def agrees():
    p, a = F.col("predicted"), F.col("actual")
    return ((p == "BUY") & (a == "UP")) | ((p == "SELL") & (a == "DOWN")) | ((p == "HOLD") & (a == "FLAT"))


def evaluate(part: DataFrame, *keys: str, days: int = 5, by: float = 2.0) -> DataFrame:
    """Momentum rule against the forward return within ``keys``; rows with neither are dropped."""
    out = momentum(forward_return(part, days, *keys), *keys).where(F.col("fwd").isNotNull() & F.col("momentum").isNotNull())
    out = out.withColumn("predicted", F.when(F.col("momentum") > by, "BUY").when(F.col("momentum") < -by, "SELL").otherwise("HOLD"))
    return out.withColumn("actual", direction("fwd")).withColumn("correct", agrees())


def run(prices: DataFrame) -> DataFrame:
    """Test rows of the 80/20 split with their verdicts."""
    return evaluate(split(prices), "split").where("split = 'test'")


def run_whole(prices: DataFrame) -> DataFrame:
    return evaluate(prices)


def metrics(rows: DataFrame) -> DataFrame:
    """``periods, accuracy, win_rate, total_return, worst, sharpe`` of each ticker; the win rate counts rises whatever the signal."""
    pct = F.col("fwd") * 100
    out = rows.groupBy("ticker").agg(F.count("*").alias("periods"), share(F.col("correct")).alias("accuracy"), share(F.col("fwd") > 0).alias("win_rate"), F.sum(pct).alias("total_return"), F.min(pct).alias("worst"), F.avg(pct).alias("_m"), F.stddev_pop(pct).alias("_s"))
    return out.withColumn("sharpe", F.when((F.col("periods") > 1) & (F.col("_s") > 0), F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0))).otherwise(0.0)).drop("_m", "_s")


def trained(prices: DataFrame, *, trim: int = 0, days: int = 5) -> DataFrame:
    """Test rows with thresholds of mean plus and minus one sample deviation of the train momentum, by window over the ticker, without a join."""
    base = split(prices)
    if trim:
        last = F.count("*").over(Window.partitionBy("ticker", "split"))
        base = base.withColumn("_k", F.row_number().over(over("split"))).withColumn("_n", last).where((F.col("split") == "train") | (F.col("_k") <= F.col("_n") - trim))
    out = momentum(forward_return(base, days, "split"), "split")
    w = Window.partitionBy("ticker")
    seen = F.when(F.col("split") == "train", F.col("momentum"))
    out = out.withColumn("high", F.avg(seen).over(w) + F.stddev_samp(seen).over(w)).withColumn("low", F.avg(seen).over(w) - F.stddev_samp(seen).over(w))
    out = out.where((F.col("split") == "test") & F.col("fwd").isNotNull() & F.col("momentum").isNotNull())
    return out.withColumn("predicted", F.when(F.col("momentum") > F.col("high"), "BUY").when(F.col("momentum") < F.col("low"), "SELL").otherwise("HOLD"))


def run_fixed(prices: DataFrame, cost: float = 0.0005) -> DataFrame:
    """Verdict by the return less costs."""
    out = trained(prices).withColumn("net", F.col("fwd") - cost)
    p, r = F.col("predicted"), F.col("net")
    return out.withColumn("correct", ((p == "BUY") & (r > 0)) | ((p == "SELL") & (r < 0)) | ((p == "HOLD") & (F.abs(r) <= 0.01)))


def run_no_bias(prices: DataFrame) -> DataFrame:
    """The last 5 test rows are cut before looking 5 ahead."""
    return trained(prices, trim=5).withColumn("actual", direction("fwd")).withColumn("correct", agrees())


def walk_windows(prices: DataFrame, length: int = 252, train: float = 0.7) -> DataFrame:
    """Rows in full windows with a row after them: ``window_num``, ``part`` (train or test)."""
    out = numbered(prices).withColumn("window_num", F.floor((F.col("rn") - 1) / length).cast("int")).where(F.col("window_num") * length < F.col("n") - length)
    return out.withColumn("part", F.when((F.col("rn") - 1) % length < int(length * train), "train").otherwise("test"))


def walk_scores(windows: DataFrame) -> DataFrame:
    """Momentum restarted in each part: 50 plus 5 times it, clamped; the first rows count 50."""
    return momentum(windows, "window_num", "part").withColumn("score", clamp(50.0 + 5.0 * F.coalesce("momentum", F.lit(0.0))))


def walk_accuracy(scored: DataFrame) -> DataFrame:
    """Share of decided scores (over 60 or under 40) in both parts of a window, their gap, and whether it is too wide."""
    sure = (F.col("score") > 60) | (F.col("score") < 40)
    out = scored.groupBy("ticker", "window_num").agg(*((F.avg(F.when(F.col("part") == p, F.when(sure, 1.0).otherwise(0.0))) * 100).alias(p) for p in ("train", "test")))
    return out.withColumn("gap", F.col("train") - F.col("test")).withColumn("overfit", F.col("gap") > 15)


def walk_summary(accuracy: DataFrame) -> DataFrame:
    out = accuracy.groupBy("ticker").agg(F.count("*").alias("windows"), F.avg("train").alias("in_sample"), F.avg("test").alias("out_sample"), F.stddev_pop("test").alias("spread"), share(F.col("gap") <= 15).alias("stability"))
    out = out.withColumn("consistency", F.greatest(F.lit(0.0), 100 - 5 * F.col("spread")))
    issues = F.when(F.col("out_sample") < 55, 30).when(F.col("out_sample") < 60, 15).otherwise(0) + F.when(F.col("consistency") < 60, 20).otherwise(0) + F.when(F.col("stability") < 70, 25).otherwise(0)
    out = out.withColumn("confidence", 100 - issues)
    return out.withColumn("verdict", F.when((F.col("confidence") == 100) & (F.col("confidence") > 65), "READY_FOR_LIVE").when(F.col("confidence") > 50, "NEEDS_TUNING").otherwise("REQUIRES_REDESIGN"))


def horizons(prices: DataFrame, days: tuple[int, ...] = (1, 5, 20, 60), least: int = 100) -> DataFrame:
    """On the last fifth of each ticker with ``least`` rows: share of rises, mean of the positive returns, sample size, by horizon."""
    part = split(prices).where((F.col("n") >= least) & (F.col("split") == "test"))
    w = over()
    wide = part.withColumns({f"_r{h}": F.lead("close", h).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1 for h in days})
    ahead = wide.select("ticker", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("r")) for h in days))).alias("x")).select("ticker", "x.horizon", "x.r")
    return ahead.where("r is not null").groupBy("ticker", "horizon").agg(share(F.col("r") > 0).alias("p_up"), (F.coalesce(F.avg(F.when(F.col("r") > 0, F.col("r"))), F.lit(0.0)) * 100).alias("e_ret"), F.count("*").alias("samples"))
