"""Technical indicators by ticker: windows where a frame says it, one ordered fold where the next value needs the last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over(*more: str) -> Window:
    return Window.partitionBy("ticker", *more).orderBy("bar_date")


def full(agg: Column, n: int, window, x: str = "close") -> Column:
    """A rolling aggregate that is null until the frame has ``n`` values."""
    frame = window.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def bollinger(prices: DataFrame, *more: str, n: int = 20, width: float = 2.0) -> DataFrame:
    w = over(*more)
    out = prices.withColumn("sma", full(F.avg("close"), n, w)).withColumn("std", full(F.stddev_samp("close"), n, w))
    return out.withColumn("upper", F.col("sma") + width * F.col("std")).withColumn("lower", F.col("sma") - width * F.col("std"))


def momentum(prices: DataFrame, *more: str, n: int = 20) -> DataFrame:
    return prices.withColumn("momentum", (F.col("close") / F.nullif(full(F.avg("close"), n, over(*more)), F.lit(0.0)) - 1) * 100)


def forward_return(prices: DataFrame, days: int, *more: str, name: str = "fwd") -> DataFrame:
    """Return over the next ``days`` rows; the partition keys keep it from looking across a split."""
    return prices.withColumn(name, F.lead("close", days).over(over(*more)) / F.nullif(F.col("close"), F.lit(0.0)) - 1)


def true_range(prices: DataFrame, n: int = 14) -> DataFrame:
    w = over()
    before = F.lag("close").over(w)
    tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    out = prices.withColumn("tr", tr)
    return out.withColumn("atr", full(F.avg("tr"), n, w, "tr"))


def rsi_sma(prices: DataFrame, n: int = 14) -> DataFrame:
    w = over()
    out = prices.withColumn("delta", F.col("close") - F.lag("close").over(w))
    out = out.withColumn("gain", F.greatest("delta", F.lit(0.0))).withColumn("loss", F.greatest(-F.col("delta"), F.lit(0.0)))
    out = out.withColumn("gain", F.when(F.col("delta").isNotNull(), F.col("gain"))).withColumn("loss", F.when(F.col("delta").isNotNull(), F.col("loss")))
    rs = full(F.avg("gain"), n, w, "gain") / F.nullif(full(F.avg("loss"), n, w, "loss"), F.lit(0.0))
    return out.withColumn("rsi", 100 - 100 / (1 + rs))


def last_rows(prices: DataFrame, n: int = 150) -> DataFrame:
    """The newest ``n`` rows of each ticker, with the ticker's row count."""
    w = Window.partitionBy("ticker")
    return prices.withColumn("n_rows", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.col("bar_date").desc()))).where(F.col("back") <= n).drop("back")


def closes(prices: DataFrame) -> DataFrame:
    """One row a ticker: ``closes`` in date order. A ticker's daily history is bounded by its days."""
    got = prices.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("bar_date", "close"))).alias("s"))
    return got.select("ticker", F.transform("s", lambda x: x["close"]).alias("closes"), F.element_at("s", -1)["bar_date"].alias("bar_date"))


def ema_step(num: Column, den: Column, x: Column, span: int) -> tuple[Column, Column]:
    keep = F.lit(1 - 2.0 / (span + 1))
    return num * keep + x, den * keep + F.lit(1.0)


def macd(series: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds ``ema_fast``, ``ema_slow``, ``macd``, ``signal_line``, ``histogram`` at the last close. Weights adjusted as over a finite history."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("fn", "fd", "sn", "sd", "gn", "gd", "m")))

    def step(s: Column, x: Column) -> Column:
        fn, fd = ema_step(s["fn"], s["fd"], x, fast)
        sn, sd = ema_step(s["sn"], s["sd"], x, slow)
        line = fn / fd - sn / sd
        gn, gd = ema_step(s["gn"], s["gd"], line, signal)
        return F.struct(fn.alias("fn"), fd.alias("fd"), sn.alias("sn"), sd.alias("sd"), gn.alias("gn"), gd.alias("gd"), line.alias("m"))

    out = series.where(F.size("closes") > 0).withColumn("_s", F.aggregate("closes", zero, step))
    out = out.withColumn("ema_fast", F.expr("_s.fn / _s.fd")).withColumn("ema_slow", F.expr("_s.sn / _s.sd")).withColumn("macd", F.col("_s.m")).withColumn("signal_line", F.expr("_s.gn / _s.gd"))
    return out.withColumn("histogram", F.col("macd") - F.col("signal_line")).drop("_s")


def rsi_wilder(series: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``rsi`` at the last close: the seed sums n + 1 changes but divides by n, and smoothing starts again at change n; no losses give 50."""
    deltas = F.transform(F.slice("closes", 2, F.greatest(F.size("closes") - 1, F.lit(0))), lambda x, i: x - F.get("closes", i))
    out = series.withColumn("_d", F.explode(F.array(deltas)))
    seed = F.slice("_d", 1, n + 1)
    up = F.aggregate(seed, F.lit(0.0), lambda s, x: s + F.when(x >= 0, x).otherwise(0.0)) / n
    down = -F.aggregate(seed, F.lit(0.0), lambda s, x: s + F.when(x < 0, x).otherwise(0.0)) / n
    start = F.struct(up.alias("u"), down.alias("d"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(((s["u"] * (n - 1) + F.greatest(x, F.lit(0.0))) / n).alias("u"), ((s["d"] * (n - 1) + F.greatest(-x, F.lit(0.0))) / n).alias("d"))

    rest = F.slice("_d", n, F.greatest(F.size("_d") - (n - 1), F.lit(0)))
    out = out.withColumn("_s", F.aggregate(rest, start, step))
    return out.withColumn("rsi", F.when(F.col("_s.d") != 0, F.expr("100 - 100 / (1 + _s.u / _s.d)")).otherwise(50.0)).drop("_s", "_d")
